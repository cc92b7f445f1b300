"""Helpers shared by the operators: scratch tables, column picks, batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one if it is unset and all runs in one process.

    Executors must be able to read what other executors wrote, so on a cluster
    without that setting this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed at the end of a ``Scratch`` block around it, or else when the driver exits."""
    path = f"{scratch_dir(spark)}/seriesloom-{name}-{uuid.uuid4().hex}"
    if not _LIVE:
        atexit.register(clear)
    # the file system's handles outlive the session, so that what it left can be removed after its end
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _LIVE[path] = target, spark.sparkContext._jsc.hadoopConfiguration()
    return path


#: Scratch paths not removed so far, with their handles.
_LIVE: dict[str, tuple] = {}


def remove(path: str) -> None:
    """Delete a scratch path through Hadoop's file system, if it still exists."""
    if path in _LIVE:
        target, conf = _LIVE.pop(path)
        target.getFileSystem(conf).delete(target, True)


def clear() -> None:
    """Remove every scratch path that is left, if the Java process still runs."""
    from py4j.protocol import Py4JError

    for path in list(_LIVE):
        try:
            remove(path)
        except (Py4JError, ConnectionError) as e:
            warnings.warn(f"{path} is left: {e}", stacklevel=1)


class Scratch:
    """A block at whose end the scratch tables made in it are removed: all results must have been written by then."""

    def __enter__(self) -> None:
        self.before = set(_LIVE)

    def __exit__(self, *_) -> None:
        for path in set(_LIVE) - self.before:
            remove(path)


class Stored:
    """A DataFrame written to the shared folder: lineage is cut, lost executors lose nothing."""

    def __init__(self, df: DataFrame, name: str) -> None:
        spark = df.sparkSession
        self.path = scratch_path(spark, name)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones cannot interfere."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def carried(df: DataFrame, names: tuple[str, ...], prefix: str, added: tuple[str, ...]) -> tuple[list[str], list[str], list[T.StructField]]:
    """Columns that pass through an operator: their names, working names and fields under these.

    Working names are numbered, so that no column of the input can clash with
    those an operator uses. A name that the result would have twice is an error.
    """
    kept = list(dict.fromkeys(names))
    if twice := {f"{prefix}{a}".lower() for a in added} & {c.lower() for c in kept}:
        raise ValueError(f"columns {sorted(twice)} are in the input already: name a prefix")
    plain = [f"_c{i}" for i in range(len(kept))]
    return kept, plain, [T.StructField(a, df.schema[c].dataType) for c, a in zip(kept, plain)]


def plain_columns(df: DataFrame, kept: list[str], plain: list[str], text_col: str) -> tuple[DataFrame, str]:
    """The carried columns under their working names, and that of the text, which is not taken twice."""
    columns = [F.col(f"`{c}`").alias(a) for c, a in zip(kept, plain)]
    if text_col in kept:
        return df.select(*columns), plain[kept.index(text_col)]
    return df.select(*columns, F.col(f"`{text_col}`").alias("_text")), "_text"


#: Bytes of texts whose features are worked out at once; arrays of some 60 bytes for each go along.
FEATURE_BYTES = 1 << 19


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of the table begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


#: Bytes of an Arrow batch to a Python worker, and Spark's own default, which is replaced by it.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "4194304b", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session has its own size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each holds about ``max_bytes``.

    A single longer text makes a slice of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def release_memory() -> None:
    """Hand back to the system what a worker, which later tasks use again, no longer needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have none
    if trim is not None:
        trim(0)
