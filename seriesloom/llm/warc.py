"""WARC archives as a Python data source, and their writing with revisit records.

Each record is a gzip member of its own that carries its compressed length in an
extra field. Reading is planned by file: small files share a partition. A reader
inflates a record's headers first; a record that the pushed-down predicates on
type and headers exclude is skipped by its length, its payload never inflated.
Writers put out uniquely named files that only the commit on the driver moves
into place, so that a lost executor's attempt leaves nothing in the archive.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import Stored, pick, scratch_path, small_batches

#: Columns of a record, in order, and the header of each that is one.
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
#: Bytes of files that share a reading partition, of reads for headers, and of other reads.
TOGETHER, PEEK, CHUNK = 64 << 20, 1 << 12, 1 << 18
#: Date of all records of the production query, so that archives can be compared.
DATE = "2024-01-01T00:00:00Z"
#: Smallest payload in bytes that is written once only.
REVISIT_BYTES = 1000
#: Digests of repeated payloads that are sent to all tasks at most; beyond it, a shuffled join is used.
SENT_DIGESTS = 200_000
#: Bytes inflated at once while the end of a record's headers is looked for; records written here name it.
STEP = 64
_PREFIX = struct.Struct("<BBBBIBBH2sHIII")


def _clean(value: object) -> str:
    """A header value on one line."""
    return " ".join(str(value).split())


def encode_record(record: dict, level: int = 4) -> bytes:
    """A record as one gzip member; the extra field ``sl`` names its length, its content's and its headers'."""
    payload = record["payload"] or b""
    lines = ["WARC/1.1"]
    lines += [f"{h}: {_clean(record[c])}" for c, h in HEADERS.items() if record[c] is not None]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    body = head + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = deflate.compress(body) + deflate.flush()
    length = _PREFIX.size + len(data) + 8
    return _PREFIX.pack(31, 139, 8, 4, 0, 0, 255, 16, b"sl", 12, length, len(body) & 0xFFFFFFFF, len(head)) + data + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)


def _open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote."""

    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """One archive file for each task, moved into place on commit."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.attempt = f"_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open_fs(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, rows = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        fs.create_dir(f"{root}/{self.attempt}", recursive=True)
                        out = fs.open_output_stream(f"{root}/{self.attempt}/{name}", compression=None)
                    out.write(encode_record(row))
                    rows += 1
        finally:
            if out is not None:
                out.close()
        return Written([name] if rows else [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open_fs(self.path)
        from pyarrow.fs import FileSelector

        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(FileSelector(root)):
                if info.is_file:
                    fs.delete_file(info.path)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{root}/{self.attempt}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = _open_fs(self.path)
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.attempt}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.attempt}")


@dataclass
class Files(InputPartition):
    """Archive files that one task reads."""

    paths: list[str]


class WarcReader(DataSourceReader):
    """Records of a folder of archives, with predicates on their headers."""

    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _open_fs(self.path)
        if fs.get_file_info(root).type != FileType.Directory:
            return [Files([])]
        found = sorted((i.path, i.size) for i in fs.get_file_info(FileSelector(root)) if i.is_file and i.path.rsplit("/", 1)[-1][0] not in "._")
        out, held, size = [], [], 0
        for path, n in found:
            if held and size + n > TOGETHER:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)]

    def wanted(self, fields: dict) -> bool:
        for column, kind, value in self.tests:
            got = fields[column]
            if got is None or (got not in value if kind == "in" else not got.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
        fs, _ = _open_fs(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for fields in read_records(f, self.wanted, self.payload):
                    rows.append(fields)
                    size += len(fields["payload"] or b"")
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _fields(head: bytes) -> dict:
    got = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        got[name.strip().lower()] = value.strip()
    out = {c: got.get(h.lower()) for c, h in HEADERS.items()}
    length = int(got.get("content-length", 0))
    out["payload_length"] = int(out["payload_length"]) if out["payload_length"] is not None else length
    out["_content"] = length
    return out


class _Member:
    """Inflates a gzip member piece by piece, no further than asked."""

    def __init__(self, f, at: int, raw: bytes, skip: int, end: int) -> None:
        self.f, self.at, self.end = f, at, end
        self.pending, self.seen = raw[skip:], at + len(raw)
        self.inflate = zlib.decompressobj(-15)

    def more(self, limit: int) -> bytes:
        """The next bytes, at most ``limit``; none at the member's or the file's end."""
        while not self.inflate.eof:
            try:
                out = self.inflate.decompress(self.pending, limit)
            except zlib.error as e:
                raise ValueError(f"the record at byte {self.at} is damaged") from e
            self.pending = self.inflate.unconsumed_tail
            if out:
                return out
            if not self.pending and not self.inflate.eof:
                if self.seen >= self.end:
                    return b""
                self.f.seek(self.seen)
                self.pending = self.f.read(min(CHUNK, self.end - self.seen))
                self.seen += len(self.pending)
        return b""

    def stop(self) -> int:
        """Where the member's trailer begins, once all is inflated."""
        return self.seen - len(self.inflate.unused_data)


def _prefix(raw: bytes, at: int) -> tuple[int, int | None, int | None]:
    """Where a member's data begin, and the length of the member and of its headers if they are named."""
    if raw[:3] != b"\x1f\x8b\x08":
        raise ValueError(f"no gzip member at byte {at}")
    flags, skip, length, head = raw[3], 10, None, None
    if flags & 4:
        sub, skip = 12, 12 + struct.unpack_from("<H", raw, 10)[0]
        while sub + 4 <= skip:
            tag, n = raw[sub : sub + 2], struct.unpack_from("<H", raw, sub + 2)[0]
            if tag == b"sl" and n >= 4:
                length = struct.unpack_from("<I", raw, sub + 4)[0]
                head = struct.unpack_from("<I", raw, sub + 12)[0] if n >= 12 else None
            sub += 4 + n
    for bit in (8, 16):  # name and comment
        if flags & bit:
            skip = raw.index(b"\0", skip) + 1
    return skip, length, head


def read_records(f, wanted, with_payload: bool = True) -> Iterator[dict]:
    """Records of an archive file whose headers ``wanted`` accepts.

    Headers are inflated alone: to their named length, or in steps of ``STEP``
    bytes until the blank line. Members with a length are skipped by it, their
    payloads not inflated; others are inflated piece by piece and thrown away, as
    their end is known no other way. A member that the file cuts short, or whose
    content does not have the length and checksum it names, is an error; of a
    payload that is skipped only the length is looked at.
    """
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        raw = f.read(min(PEEK, size - at))
        skip, length, named = _prefix(raw, at)
        if length and (length < skip + 8 or at + length > size):
            raise ValueError(f"the archive ends within the record at byte {at}")
        member = _Member(f, at, raw, skip, at + length if length else size)
        data = b""
        while b"\r\n\r\n" not in data and (got := member.more(max(STEP, (named or 0) - len(data)))):
            data += got
        head, gap, rest = data.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError(f"the headers of the record at byte {at} have no end")
        fields = _fields(head)
        take = wanted(fields)
        payload = [rest]
        end = at + length if length else None
        if not length or take and with_payload:
            crc, total = zlib.crc32(data), len(data)
            while more := member.more(CHUNK):
                crc, total = zlib.crc32(more, crc), total + len(more)
                if take and with_payload:
                    payload.append(more)
            f.seek(member.stop())
            trailer = f.read(8)
            content = total - len(head) - len(gap)
            end = member.stop() + 8
            if not member.inflate.eof or len(trailer) < 8 or struct.unpack("<II", trailer) != (crc, total & 0xFFFFFFFF) or content < fields["_content"] or length and end != at + length:
                raise ValueError(f"the record at byte {at} is damaged")
        at = end
        if take:
            n = fields.pop("_content")
            fields["payload"] = b"".join(payload)[:n] if with_payload else None
            yield fields


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")`` over a folder."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder; without payloads if they are not needed."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, least: int = REVISIT_BYTES) -> DataFrame:
    """Records for pages: one response for each payload of at least ``least`` bytes, revisits for the rest of its pages.

    Null html is an empty payload; a null identifier stays null and is never
    referred to unless no page of the payload has one. The largest identifier
    is the response; repeated rows of it are responses as well.
    """
    slim = pick(pages, *dict.fromkeys([id_col, url_col, html_col])).select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload")
    )
    sized = slim.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    repeated = sized.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first")
    kept = Stored(repeated, "repeated").df
    small = kept.count() <= SENT_DIGESTS
    joined = sized.join(F.broadcast(kept) if small else kept, "digest", "left")
    again = F.coalesce(F.col("page_id") < F.col("first"), F.col("first").isNotNull() & F.col("page_id").isNull())
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("bytes").alias("payload_length"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.when(again, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (columns of ``SCHEMA``) as archives into a folder that all executors share."""
    register(records.sparkSession)
    small_batches(records.sparkSession)
    records.write.format("warc").mode("append").option("path", path).save()


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as archives, read them back and describe each page's record.

    ``page_id``, ``payload_bytes`` and ``payload_digest`` (of the payload read
    back for responses, of the headers for revisits, whose payloads are skipped),
    ``record_type`` and ``refers_to``. Null html is an empty payload. A null
    identifier comes back as null and is referred to by no page that has one;
    repeated rows are records one by one, those of the largest identifier all
    responses. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(page_records(pages, id_col, url_col, html_col), path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    full = read_warc(spark, path).where("record_type = 'response'").select(
        number(F.col("record_id")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(
        number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to")
    )
    return full.unionByName(again)
