"""Exact top-k search by distributed histogram selection.

Every query is scored against every row. Global histograms of the scores narrow
down the interval that holds each query's k-th highest score until it is one
value; the rows at or above it are then filtered and ties broken by identifier.
A task reports only the bins from the top down to its own k-th score: the global
k-th score cannot lie below, so nothing that matters is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, pick

#: Queries scored at once; their vectors are sent to all tasks, which hold ``BINS`` counts for each.
BLOCK = 4096
#: Bins of a histogram.
BINS = 256
#: Scores held at once in a task.
CELLS = 4 << 20
#: Squared length of a quantised vector at most; by Cauchy-Schwarz no score is larger, so all fit 64 bits.
LONGEST = float(1 << 61)
#: Products below this are exact in double precision.
EXACT = 1 << 53


def quantised(column: pa.Array, scale: float = 256.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and ``floor(scale * x)`` of the vectors of each size; null vectors and those with null or non-finite components are left out."""
    if not len(column):
        return
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, np.diff(offsets), -1)
    for size in np.unique(sizes[valid]).tolist():
        at = np.flatnonzero(sizes == size)
        x = values[offsets[at][:, None] + np.arange(size)]
        usable = np.isfinite(x).all(1)
        if usable.any():
            yield at[usable], np.floor(scale * x[usable])


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Identifiers and quantised vectors of a batch, by vector size."""
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    for at, rows in bounded(batch.column("vector")):
        yield ids[at], rows


def bounded(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``quantised`` gives, without vectors whose squared length is beyond ``LONGEST``."""
    for at, rows in quantised(column):
        with np.errstate(over="ignore"):
            near = np.square(rows).sum(1) <= LONGEST
        if near.any():
            yield at[near], rows[near]


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products; exact beyond double precision too."""
    if rows.size and queries.size and float(np.abs(rows).max()) * float(np.abs(queries).max()) * rows.shape[1] >= EXACT:
        as_int = lambda a: np.array([[int(x) for x in r] for r in a], dtype=object)
        return (as_int(rows) @ as_int(queries).T).astype(np.int64)
    return (rows @ queries.T).astype(np.int64)


class _Block:
    """Queries of one block, by vector size: positions, identifiers, vectors."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array) -> None:
        self.ids = ids
        self.sizes = {q.shape[1]: (at, q) for at, q in bounded(vectors)}

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Query positions, row identifiers, scores, and which cells count (not a query's own row)."""
        for batch in batches:
            for ids, rows in _by_size(batch):
                at, q = self.sizes.get(rows.shape[1], (None, None))
                if at is None:
                    continue
                step = max(1, CELLS // len(at))
                for s in range(0, len(ids), step):
                    part = ids[s : s + step]
                    yield at, part, _scores(rows[s : s + step], q).T, self.ids[at][:, None] != part[None, :]


def _histogram(block, low: np.ndarray, high: np.ndarray, width: np.ndarray, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        n = len(b.ids)
        counts = np.zeros((n, BINS), np.int64)
        above = np.zeros(n, np.int64)
        for at, _, scores, counted in b.scored(batches):
            place = (scores - low[at][:, None]) // width[at][:, None]
            over = scores >= high[at][:, None]  # counted off in earlier rounds
            above[at] += (counted & over).sum(1)
            inside = counted & ~over & (place >= 0)
            cells = (at[:, None] * BINS + place)[inside]
            counts += np.bincount(cells, minlength=n * BINS).reshape(n, BINS)
        # from the top down to the bin of this task's own k-th score
        down = counts[:, ::-1].cumsum(1)[:, ::-1] - counts + above[:, None]
        q, bins = np.nonzero((counts > 0) & (down < k))
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "bin": pa.array(bins, pa.int32()), "n": pa.array(counts[q, bins], pa.int64())})

    return work


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most = 0.0
    for batch in batches:
        for _, rows in _by_size(batch):
            most = max(most, float(np.sqrt((rows * rows).sum(1)).max(initial=0.0)))
    yield pa.RecordBatch.from_pydict({"norm": pa.array([most], pa.float64())})


def _kth(rows: DataFrame, block, longest: float, k: int) -> np.ndarray:
    """k-th highest score of each query, or a value below all scores if there are fewer."""
    n = len(block.value.ids)
    norms = np.zeros(n)
    for at, q in block.value.sizes.values():
        norms[at] = np.sqrt((q * q).sum(1))
    bound = np.ceil(norms * longest * (1 + 1e-12)).astype(np.int64) + 1
    low, high = -bound, bound + 1
    need = np.full(n, k)
    while (high - low).max() > 1:
        width = -(-(high - low) // BINS)
        got = rows.mapInArrow(_histogram(block, low, high, width, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((n, BINS + 1), np.int64)
        counts[np.asarray(got["q"]), np.asarray(got["bin"])] = np.asarray(got["n"])
        down = counts[:, ::-1].cumsum(1)[:, ::-1]
        enough = down[:, :BINS] >= need[:, None]
        few = ~enough[:, 0]
        b = BINS - 1 - enough[:, ::-1].argmax(1)
        need = np.where(few, need, need - down[np.arange(n), b + 1])
        low = np.where(few, -bound - 1, low + width * b)
        high = np.where(few, low + 1, np.minimum(high, low + width))
    return low


def _filtered(block, least: np.ndarray, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, ids, scores, counted in b.scored(batches):
            take = counted & (scores >= least[at][:, None])
            for row in np.flatnonzero(take.any(1)):
                q, cells = int(at[row]), take[row]
                s, i = scores[row][cells], ids[cells]
                if q in best:
                    s, i = np.concatenate([best[q][0], s]), np.concatenate([best[q][1], i])
                order = np.lexsort((i, -s))[:k]
                best[q] = (s[order], i[order])
        for q, (s, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), b.ids[q])), pa.array(i), pa.array(s)], schema=schema)

    return work


def exact_top_k(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query with all rows but its own.

    ``is_query`` is a predicate over ``vec_id``. Vectors that are null or hold
    null or non-finite components, and rows without identifier, take no part, nor
    do those whose squared length after quantisation is beyond 2**61, as their scores need not
    fit a long;
    vectors of different sizes have no score. Ties go to the smaller identifier;
    repeated rows are candidates one by one, and a repeated query identifier is
    asked once, with its least vector. Queries with no candidate, and empty
    tables, give no rows. Columns: ``query_id``, ``rank``, ``vec_id``, ``score``.
    """
    spark = vectors.sparkSession
    slim = pick(vectors, id_col, vector_col).toDF("vec_id", "vector").where("vec_id is not null and vector is not null")
    rows = slim.select(F.col("vec_id").alias("id"), "vector")
    asked = slim.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = Stored(asked, "queries").df
    total = asked.count()
    longest = rows.mapInArrow(_norms, "norm double").agg(F.max("norm")).first()[0] or 0.0
    blocks = max(1, -(-total // BLOCK))
    parts = []
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").toArrow()
        held = _Block(mine["vec_id"].to_numpy(), mine["vector"].combine_chunks())
        if not held.sizes:
            continue
        block = spark.sparkContext.broadcast(held)
        least = _kth(rows, block, longest, k)
        parts.append(Stored(rows.mapInArrow(_filtered(block, least, k), "query_id long, vec_id long, score long"), "best").df)
        block.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
