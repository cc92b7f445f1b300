"""Centroid clustering with block-norm screening.

A vector is compressed to the norms of its segments. By Cauchy-Schwarz the inner
product of two vectors is at most that of their segment norms, so

    |x - c|^2 >= |x|^2 + |c|^2 - 2 * sum of |x_s| |c_s|

bounds each distance from below at a fraction of its cost. A vector's exact
integer distance to its most promising centroid is an upper bound; centroids
whose lower bound exceeds it are pruned, and only the others get exact integer
distances. Vectors and their segment norms are worked out once and stored; each
round sends the centroids, a table of fixed size, and brings back sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, pick
from .topk import quantised

#: Components of one segment.
SEGMENT = 8
#: Squared length of a quantised vector at most; then squared distances stay below 2**62.
LONGEST = float(1 << 60)
#: Share by which a bound is lowered for the rounding of norms.
SLACK = 1e-9
#: Partial sums of one centroid are added in so many places before they meet.
PLACES = 64


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Norms of the segments of each row; the last segment may be shorter."""
    return np.sqrt(np.add.reduceat(np.square(x, dtype=np.float64), np.arange(0, x.shape[1], segment), axis=1))


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to one integer centroid, in 64 bits."""
    return np.square(x - c).sum(1)


def screened(x: np.ndarray, norms: np.ndarray, c: np.ndarray, c_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance, and how many exact distances it took.

    Ties go to the centroid with the smaller number.
    """
    n, k = len(x), len(c)
    length = np.square(norms).sum(1)
    own = np.square(c_norms).sum(1)
    low = length[:, None] + own[None, :] - 2.0 * (norms @ c_norms.T) - SLACK * (length[:, None] + own[None, :]) - 1.0
    cluster = low.argmin(1)
    best = np.empty(n, np.int64)
    for j in np.unique(cluster):
        rows = np.flatnonzero(cluster == j)
        best[rows] = exact_distances(x[rows], c[j])
    first, took = cluster.copy(), n
    for j in range(k):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        if not len(rows):
            continue
        took += len(rows)
        d = exact_distances(x[rows], c[j])
        better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        best[rows[better]] = d[better]
        cluster[rows[better]] = j
    return cluster, best, took


def _compress(dims: int, segment: int):
    schema = pa.schema([("vec_id", pa.int64()), ("q", pa.binary()), ("norms", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in quantised(batch.column("vector")):
                if rows.shape[1] != dims:
                    continue
                with np.errstate(over="ignore"):
                    near = np.square(rows).sum(1) <= LONGEST
                at, rows = at[near], rows[near]
                q, norms = rows.astype(np.int32), segment_norms(rows, segment)  # no component is beyond 2**30
                ids = batch.column("vec_id").take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([r.tobytes() for r in q], pa.binary()), pa.array([r.tobytes() for r in norms], pa.binary())], schema=schema)

    return work


def _read(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors and segment norms of a stored batch."""
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("q").to_pylist()), np.int32).reshape(n, dims)
    norms = np.frombuffer(b"".join(batch.column("norms").to_pylist()), np.float64).reshape(n, -1)
    return x.astype(np.int64), norms


def _sums(sent, dims: int, segment: int):
    """Each task's sums: one row for each centroid that has vectors there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        c_norms = segment_norms(c, segment)
        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, norms = _read(batch, dims)
                cluster = screened(x, norms, c, c_norms)[0]
                n += np.bincount(cluster, minlength=len(c))
                order = np.argsort(cluster, kind="stable")
                heads = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                total[cluster[order][heads]] += np.add.reduceat(x[order], heads, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some])} | {f"s{d}": pa.array(total[some, d]) for d in range(dims)})

    return work


def _assigned(sent, dims: int, segment: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        c_norms = segment_norms(c, segment)
        for batch in batches:
            if batch.num_rows:
                x, norms = _read(batch, dims)
                cluster, distance, _ = screened(x, norms, c, c_norms)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)})

    return work


def _moved(vectors: DataFrame, c: np.ndarray, segment: int) -> np.ndarray:
    """Centroids moved to the floored mean of their vectors; empty ones stay."""
    spark, (k, dims) = vectors.sparkSession, c.shape
    sent = spark.sparkContext.broadcast(c)
    names = [f"s{d}" for d in range(dims)]
    shape = "cluster int, n long, " + ", ".join(f"{s} long" for s in names)
    parts = vectors.mapInArrow(_sums(sent, dims, segment), shape)
    added = [F.sum(s).alias(s) for s in ["n", *names]]
    near = parts.groupBy("cluster", (F.spark_partition_id() % PLACES).alias("place")).agg(*added)
    out = c.copy()
    for row in near.groupBy("cluster").agg(*added).collect():  # one row for each centroid at most
        out[row.cluster] = [row[s] // row.n for s in names]
    sent.unpersist()
    return out


def hash_order(prefix: str, id_col: str = "vec_id") -> Column:
    """Lowercase hexadecimal sha256 of a prefix and a decimal identifier; the starting centroids are its least."""
    return F.sha2(F.concat(F.lit(prefix), F.col(id_col).cast("string")), 256)


def clusters(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    seed: str = "2:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    segment: int = SEGMENT,
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector.

    Components become ``floor(256 * x)``. Vectors that are null, have another
    size, or hold null or non-finite components take no part, nor do those whose
    squared integer length is beyond 2**60, as their distances need not fit a
    long. The first centroids are the ``k`` vectors with the least hash of seed
    and identifier, repeated identifiers ordered by their vectors; fewer
    vectors make fewer centroids. Rows without identifier never start a
    centroid but are assigned like all others (no row has an identifier: an empty
    result); repeated rows count one by one.
    Ties of distance go to the centroid with the smaller number. Inertias
    beyond a long are null. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    slim = pick(vectors, id_col, vector_col).toDF("vec_id", "vector").where("vector is not null")
    stored = Stored(slim.mapInArrow(_compress(dims, segment), "vec_id long, q binary, norms binary"), "vectors")
    first = stored.df.where("vec_id is not null").select("q", hash_order(seed).alias("h")).orderBy("h", "q").limit(k).collect()
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], empty)
    c = np.stack([np.frombuffer(r.q, np.int32) for r in first]).astype(np.int64)
    for _ in range(rounds):
        c = _moved(stored.df, c, segment)
    sent = spark.sparkContext.broadcast(c)
    placed = Stored(stored.df.mapInArrow(_assigned(sent, dims, segment), "vec_id long, cluster int, distance long"), "assigned").df
    stored.drop()
    part = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    fits = lambda v: v if v < 1 << 63 else None
    total = fits(sum(int(r.d) for r in part))
    marks = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    about = spark.createDataFrame([(r.cluster, fits(int(r.d)), total, marks[r.cluster]) for r in part], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = placed.join(F.broadcast(about), "cluster")  # at most one row for each centroid
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
