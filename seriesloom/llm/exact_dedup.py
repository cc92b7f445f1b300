"""Exact deduplication by sorting content.

Sampled splitters range-partition the normalised text, an external sort inside
each partition places equal texts next to each other, and a streaming pass
compares full neighbours. The splitters also hold the length and identifier, so
that a group of copies of any size spreads over as many partitions as it needs;
the at most two runs of a partition that touch its borders are then joined
across partitions by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, carried, plain_columns, small_batches

#: Characters that do not count when texts are compared.
SPACES = " \t\n\x0b\x0c\r"
#: Characters of the normalised text that the splitters hold.
SPLITTER_CHARS = 64
#: Border runs that are sent to all tasks at most; beyond it, a shuffled join is used.
SENT_RUNS = 200_000


def _runs(id_name: str, plain: list[str], schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # slices of the open run
        held_key, first_id, run = None, None, 0

        def close(last: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            digest = hashlib.sha256(held_key).hexdigest()
            # rows are ordered by length and identifier, so the first of a run is its best
            cols = {c: table.column(c) for c in plain} | {
                "keep_id": pa.array([first_id] * n, pa.int64()),
                "keep_chars": pa.array([table.column("_n")[0].as_py()] * n, pa.int64()),
                "group_size": pa.array([n] * n, pa.int64()),
                "first": pa.array([True] + [False] * (n - 1)),
                "text_sha256": pa.array([digest] * n),
                "edge": pa.array([run == 0 or last] * n),
                "run": pa.array([(part << 32) + run] * n, pa.int64()),
            }
            return pa.Table.from_pydict(cols, schema=schema).to_batches()[0]

        for batch in batches:
            keys = batch.column("_norm").to_pylist()
            ids = batch.column(id_name)
            slim = batch.select([*plain, "_n"])
            start = 0
            for i, key in enumerate(keys):
                if key == held_key:
                    continue
                if i > start:
                    held.append(slim.slice(start, i - start))
                if held:
                    yield close(False)
                    held, run = [], run + 1
                held_key, first_id, start = key, ids[i].as_py(), i
            if len(keys) > start:
                held.append(slim.slice(start))
        if held:
            yield close(True)

    return work


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """One row per input row with the row that stays for its text.

    Texts are equal when identical without the characters of ``SPACES``; null
    counts as empty. Of equal texts the row with the most code points in the
    original text stays, then the smallest identifier; among repeated rows with
    the same identifier exactly one is kept, and a null identifier loses to any
    other. Returns the identifier, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and the columns named in ``carry``; the names of the new ones
    begin with ``prefix``, so that columns of any name can be carried. An empty
    table gives an empty result; columns not named are ignored.
    """
    small_batches(docs.sparkSession)
    kept, plain, fields = carried(docs, (id_col, *carry), prefix, ("keep_id", "group_size", "kept", "text_sha256"))
    slim, text_name = plain_columns(docs, kept, plain, text_col)
    text = F.coalesce(F.col(text_name), F.lit(""))
    norm = F.translate(text, SPACES, "")
    keyed = (
        slim.withColumn("_n", F.length(text).cast("long"))
        .withColumn("_p", F.substring(norm, 1, SPLITTER_CHARS))
        .withColumn("_h", F.xxhash64(norm))
        .withColumn("_g", F.xxhash64(F.lit(1), norm))
    )
    own = plain[0]
    order = [F.col("_n").desc(), F.col(own).asc_nulls_last()]
    ranged = keyed.repartitionByRange(F.col("_p"), F.col("_h"), F.col("_g"), *order)
    ready = ranged.withColumn("_norm", norm).sortWithinPartitions("_p", "_h", "_g", "_norm", *order)
    ready = ready.select(*plain, "_n", F.encode("_norm", "UTF-8").alias("_norm"))
    schema = T.StructType(
        [
            *fields,
            T.StructField("keep_id", T.LongType()),
            T.StructField("keep_chars", T.LongType()),
            T.StructField("group_size", T.LongType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("edge", T.BooleanType()),
            T.StructField("run", T.LongType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    runs = Stored(ready.mapInArrow(_runs(own, plain, to_arrow_schema(schema)), schema), "runs").df
    # at most two runs of each partition touch its borders
    best = F.struct((-F.col("keep_chars")).alias("c"), F.coalesce("keep_id", F.lit(2**63 - 1)).alias("i"), F.col("run").alias("r"))
    seams = Stored(
        runs.where("edge and first")
        .groupBy("text_sha256")
        .agg(F.sum("group_size").alias("_size"), F.min(best).alias("_best"), F.min_by("keep_id", best).alias("_keep")),
        "seams",
    ).df
    small = seams.count() <= SENT_RUNS
    joined = runs.join(F.broadcast(seams) if small else seams, "text_sha256", "left")
    seam = F.col("edge") & F.col("_best").isNotNull()
    return joined.select(
        *[F.col(a).alias(c) for c, a in zip(kept, plain)],
        F.when(seam, F.col("_keep")).otherwise(F.col("keep_id")).alias(f"{prefix}keep_id"),
        F.when(seam, F.col("_size")).otherwise(F.col("group_size")).cast("long").alias(f"{prefix}group_size"),
        (F.col("first") & F.when(seam, F.col("run") == F.col("_best.r")).otherwise(F.lit(True))).alias(f"{prefix}kept"),
        F.col("text_sha256").alias(f"{prefix}text_sha256"),
    )
