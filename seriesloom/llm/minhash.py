"""MinHash near-duplicates by tensored banding, verified on full sets.

Two small collections of hashes are drawn from each document's shingle set; a
hash is made of ``ROWS`` minhashes. A table key is a pair of one hash of each
collection, so ``SIDE`` hashes a side give ``SIDE ** 2`` tables, for
``2 * SIDE * ROWS`` minhashes in place of ``2 * SIDE ** 2 * ROWS``. A pair of
similarity s shares a key unless all hashes of one side differ:
(1 - (1 - s ** ROWS) ** SIDE) ** 2, which misses about 1 in 100,000 of the pairs
at 0.8, and fewer the more alike they are.

A key can only be shared if both of its hashes are. So the hashes, a few rows for
each document, are counted first, and keys are formed from those alone that
occur more than once; most documents of a corpus have none. Candidates are
verified as in the exact join: parity sketches, then whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, small_batches, text_slices
from .jaccard_join import linked_components, parity_sketch, slim_documents
from .shingles import mixed, set_key, shingle_sets

#: Minhashes of one hash, and hashes of one collection.
ROWS, SIDE = 2, 12
#: Documents that one bucket of a key takes, about.
BUCKET = 4096
#: Odd multiplier that joins hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose minhashes are worked out at once.
CELLS = 1 << 16

_SEEDS = np.random.default_rng(20240613).integers(1, 1 << 63, (2, 2 * SIDE * ROWS), dtype=np.uint64)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """Hashes of both collections, of 32 bits, for each set that is not empty: one row of ``2 * SIDE``."""
    ends = np.cumsum([len(s) for s in sets])
    flat, heads = np.concatenate(sets), np.concatenate([[0], ends[:-1]])
    least = np.empty((2 * SIDE * ROWS, len(sets)), np.uint64)
    for f in range(len(least)):
        least[f] = np.minimum.reduceat(mixed((flat ^ _SEEDS[0, f]) * (_SEEDS[1, f] | np.uint64(1))), heads)
    out = np.zeros((len(sets), 2 * SIDE), np.uint32)
    for slot in range(2 * SIDE):
        h = np.full(len(sets), slot, np.uint64)
        for f in range(slot * ROWS, (slot + 1) * ROWS):
            h = mixed((h * STEP) ^ least[f])
        out[:, slot] = h >> np.uint64(32)
    return out


def slot_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hashes with their place in front, so that those of different places differ."""
    return hashes.astype(np.uint64) | np.arange(2 * SIDE, dtype=np.uint64) << np.uint64(32)


def table_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a hash of the first collection and one of the second."""
    return mixed((left * STEP) ^ right).view(np.int64)


def first_shared(rows: np.ndarray, one: np.ndarray, key: int) -> np.ndarray:
    """Whether a key is the first one that each row of hashes shares with ``one``: a pair is listed there alone."""
    same = rows == one
    left, right = same[:, :SIDE].argmax(1), SIDE + same[:, SIDE:].argmax(1)
    own = slot_hashes(one)
    return table_keys(own[left], own[right]) == key


def _hashed(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("mark", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes: list[bytes | None] = [None] * len(sets)
            at = 0
            while at < len(full):
                stop, size = at, 0
                while stop < len(full) and (stop == at or size + len(sets[full[stop]]) <= CELLS):
                    size += len(sets[full[stop]])
                    stop += 1
                for i, row in zip(full[at:stop], minhashes([sets[i] for i in full[at:stop]])):
                    hashes[i] = row.tobytes()
                at = stop
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(hashes, pa.binary()),
                ],
                schema=schema,
            )

    return work


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each hash of a node."""
    for batch in batches:
        if batch.num_rows:
            h = np.frombuffer(b"".join(batch.column("mark").to_pylist()), np.uint32).reshape(-1, 2 * SIDE)
            node, n = (np.repeat(batch.column(c).to_numpy(), 2 * SIDE) for c in ("node", "n"))
            yield pa.RecordBatch.from_pydict({"hash": pa.array(slot_hashes(h).ravel().view(np.int64)), "node": pa.array(node), "n": pa.array(n.astype(np.int32))})


def _keys(percent: int):
    schema = pa.schema([("sig", pa.int64()), ("salt", pa.int32()), ("rare", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("most", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of each node from its shared hashes; keys that may be met by many nodes are cut into buckets."""
        for batch in batches:
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for node, n, shared in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("shared").to_pylist()):
                left = [(x["hash"], x["met"]) for x in shared if x["hash"] >> 32 < SIDE]
                right = [(x["hash"], x["met"]) for x in shared if x["hash"] >> 32 >= SIDE]
                if not left or not right:
                    continue
                a, b = (np.array([x[0] for x in side], np.int64).view(np.uint64) for side in (left, right))
                ma, mb = (np.array([x[1] for x in side], np.int64) for side in (left, right))
                sig = table_keys(np.repeat(a, len(b)), np.tile(b, len(a)))
                # no more nodes can meet under a key than under either of its hashes
                met = np.minimum(ma[:, None], mb[None, :]).ravel()
                cut = 1 << np.ceil(np.log2(np.maximum(met / BUCKET, 1))).astype(np.int64)
                # a bucket's first node is the one whose hashes are met most: of a text and its copies that is the text
                rank = -min(int(ma.sum() + mb.sum()), (1 << 31) - 1)
                parts.append((sig, np.where(cut > 1, node & cut - 1, -1), np.full(len(sig), rank), np.full(len(sig), node, np.int64), np.full(len(sig), n, np.int32)))
            if parts:
                sig, salt, rank, node, n = (np.concatenate(c) for c in zip(*parts))
                columns = [sig, salt.astype(np.int32), rank.astype(np.int32), node, n, (100 * n.astype(np.int64) // percent).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return work


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Documents are linked when ``100 * intersection >= percent * union`` of their
    sets of ``width``-word shingles; the component is the smallest identifier
    reachable by links, and the row with that identifier is kept. Null and empty
    texts have no shingles, are linked with nothing and kept. Rows with equal
    sets are one node, so that repeated rows are harmless (all rows of a kept
    identifier are kept). Rows without identifier never name a component unless
    all of it is null; ``kept`` is then null, as nothing tells its rows apart. An
    empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    slim = slim_documents(docs, id_col, text_col)
    first = Stored(slim.mapInArrow(_hashed(width), "doc_id long, n_shingles long, node long, sketch binary, mark binary"), "hashes").df
    alike = first.where("node is not null").groupBy("node")
    nodes = Stored(alike.agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.max("mark").alias("mark")), "nodes").df
    slots = nodes.select("node", "n", "mark").mapInArrow(_slots, "hash long, node long, n int")
    shared = slots.groupBy("hash").agg(F.count("*").alias("met")).where("met > 1")
    mine = slots.join(shared, "hash").groupBy("node").agg(F.max("n").alias("n"), F.collect_list(F.struct("hash", "met")).alias("shared"))
    posted = mine.mapInArrow(_keys(percent), "sig long, salt int, rare int, node long, n int, most int")
    found = linked_components(slim, first.select("doc_id", "n_shingles", "node"), nodes, posted, width, percent, first_shared)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
