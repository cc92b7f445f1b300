"""Set similarity join on word shingles by token-combination prefixes.

Shingles are ordered by class, then by hash: those of the rare class come first,
the frequent class last. The class follows from counts of all shingles of the
corpus, kept in a table of fixed size, so it only steers the work; links do not
depend on it. A document's prefix is extended until no choice of the shingles
that a linked partner may lack can hide all its signatures: rare shingles are
signatures by themselves, frequent ones in combinations of two, which cost one
shingle more of prefix. Long sets, whose combinations would be too many, keep
single frequent shingles; the sizes where both forms are written overlap, so
that no two sets that could be linked use different forms.

Documents that share a signature are first verified against one of them, the one
with the fewest rare shingles. Components of the links found so far then tell
which signatures still join documents of different components, and only for
these the remaining pairs are verified. Before sets are sent around, pairs are
dropped whose parity sketches differ in more places than linked sets can; what is
left is compared in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, small_batches, text_slices
from .components import components
from .shingles import set_key, shingle_sets

#: Counters of the shingle statistics, and of one row in which a task hands some of them on.
COUNTERS, BLOCK = 1 << 20, 1 << 12
#: A shingle is frequent if its counter exceeds the mean by this much, or by six deviations.
FREQUENT = 128
#: Sets of up to so many shingles use combinations with all partners.
COMBINED = 192
#: Sub-buckets of a signature that holds frequent shingles at least, and the power of two of documents that one takes.
SALTS, SALT_BITS = 16, 12
#: Identifiers that are sent to all tasks at most (with what goes along, some 50 bytes each); beyond it, a shuffled join is used.
SENT_IDS = 400_000
#: Documents compared with one task's copy of the document that they all meet.
MEET = 256
#: Rows of a side of a tile, about, and bytes of the sketches that are compared there.
TILE, MINI = 8192, 64
#: Local sets remembered to leave out copies from the counts.
SEEN = 250_000


def _meets(n, m):
    """Least intersection of linked sets of n and m shingles: 100 * i >= 75 * (n + m - i)."""
    return -(-3 * (n + m) // 7)


def parity_sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles in each of a power of two of cells, no fewer than shingles.

    Two sets differ in at least as many shingles as their sketches in bits; a
    larger sketch folds into a smaller one.
    """
    cells = max(64, 1 << (len(s) - 1).bit_length())
    hit = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((hit & 1).astype(np.uint8)).tobytes()


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int = 75) -> bool:
    """Whether sketches of sets of n and m shingles allow a link; at 75 percent these differ in at most (n + m) / 7."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (100 + percent) * int(np.bitwise_count(a ^ b).sum()) <= (100 - percent) * (n + m)


def folded(sketch: bytes) -> bytes:
    """A sketch folded to ``MINI`` bytes at most."""
    v = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(v.reshape(-1, MINI), axis=0).tobytes() if len(v) > MINI else sketch


def _counts(id_col: str, text_col: str, width: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint32)
        seen: set[int] = set()
        for batch in text_slices(batches, text_col):
            sizes, nodes, sketches, fresh = [], [], [], []
            for s in shingle_sets(batch.column(text_col).to_pylist(), width):
                sizes.append(len(s))
                nodes.append(key := set_key(s) if len(s) else None)
                sketches.append(parity_sketch(s) if len(s) else None)
                if key is not None and key not in seen:
                    fresh.append(s)
                    if len(seen) < SEEN:
                        seen.add(key)
            if fresh:
                counters += np.bincount((np.concatenate(fresh) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                schema=schema,
            )
        k = COUNTERS // BLOCK
        blocks = [counters[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(blocks, pa.binary())],
            schema=schema,
        )

    return work


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counter rows of a task, one array for each block number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts")):
            got = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.uint64)
            sums[b] = sums[b] + got if b in sums else got
    if sums:
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": pa.array([v.astype(np.uint32).tobytes() for v in sums.values()], pa.binary())})


def frequent_counters(rows: DataFrame) -> np.ndarray:
    """Bits in the count of each counter that stands out, 0 for the others, from the counter rows of all tasks.

    The driver gets the summed table, 4 MB whatever the corpus.
    """
    total = rows.select("block", "counts").repartition("block").mapInArrow(_add_blocks, "block int, counts binary")
    got = np.zeros(COUNTERS, np.float64)
    for r in total.collect():
        got[r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(r.counts, np.uint32)
    mean = got.mean()
    often = got > mean + max(FREQUENT, 6 * np.sqrt(mean))
    return np.where(often, np.ceil(np.log2(np.maximum(got, 2))), 0).astype(np.uint8)


def signatures(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Signatures of a set, the position of the first shingle of each, how frequent each is (0: rare), and the count of rare shingles."""
    n = len(s)
    level = levels[(s >> np.uint64(44)).astype(np.int64)]
    often = level > 0
    cost = n - -(-3 * n // 4) + 1
    rare = s[~often]
    first = rare[:cost]
    sig, pos, hot = [first], [np.arange(len(first))], [np.zeros(len(first), np.uint8)]
    if (left := cost - len(first)) > 0:
        common, level = s[often], level[often]
        if 3 * n <= 4 * COMBINED:
            c = common[: left + 1]
            i, j = np.triu_indices(len(c), 1)
            sig.append((c[i] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[j] >> np.uint64(1)) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            pos.append(len(rare) + i)
            hot.append(np.minimum(level[i], level[j]))
        if n > COMBINED:
            sig.append(common[:left] ^ np.uint64(0x5BD1E9955BD1E995))
            pos.append(len(rare) + np.arange(min(left, len(common))))
            hot.append(level[:left])
    return np.concatenate(sig), np.concatenate(pos), np.concatenate(hot), len(rare)


def _postings(text_col: str, width: int, bits):
    schema = pa.schema([("sig", pa.int64()), ("salt", pa.int32()), ("rare", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("most", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(bits.value, np.uint8)
        for batch in text_slices(batches, text_col):
            cols: list[list[np.ndarray]] = [[] for _ in schema]
            for s in shingle_sets(batch.column(text_col).to_pylist(), width):
                if not len(s):
                    continue
                sig, pos, hot, rare = signatures(s, levels)
                n, k, node = len(s), len(sig), set_key(s)
                values = (
                    sig.view(np.int64),
                    np.where(hot > 0, node & np.maximum(SALTS, 1 << np.maximum(hot.astype(np.int64) - SALT_BITS, 0)) - 1, -1).astype(np.int32),
                    np.full(k, rare, np.int32),
                    np.full(k, node, np.int64),
                    np.full(k, n, np.int32),
                    # the largest partner whose needed intersection still fits behind the position
                    (7 * (n - pos) // 3 - n).astype(np.int32),
                )
                for c, v in zip(cols, values):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=schema)

    return work


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to each posting the first document of its bucket; rows come sorted by bucket.

    Buckets of one document are left out unless they are parts of a larger one.
    """
    names = ["sig", "salt", "node", "n", "most"]
    hub = None  # (sig, salt, node, n, most) of the open bucket
    waiting = None  # its first row, until a second one follows

    def emit(cols: dict[str, np.ndarray], hubs: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        out = {k: pa.array(cols[k][keep]) for k in names} | {f"hub_{k}": pa.array(hubs[k][keep]) for k in ("node", "n", "most")}
        return pa.RecordBatch.from_pydict(out)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        if waiting is not None:
            cols = {k: np.concatenate([waiting[k], cols[k]]) for k in names}
        n = len(cols["sig"])
        new = np.ones(n, bool)
        new[1:] = (cols["sig"][1:] != cols["sig"][:-1]) | (cols["salt"][1:] != cols["salt"][:-1])
        carried = waiting is None and hub is not None and hub["sig"] == cols["sig"][0] and hub["salt"] == cols["salt"][0]
        if carried:
            new[0] = False
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        hubs = {}
        for k in ("node", "n", "most"):
            v = cols[k][heads]
            hubs[k] = (np.concatenate([[hub[k]], v])[group + 1] if carried else v[group]).astype(cols[k].dtype)
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        alone = new & last & (cols["salt"] < 0)
        wait = alone[-1]
        keep = ~alone
        if keep.any():
            yield emit(cols, hubs, keep)
        waiting = {k: cols[k][-1:] for k in names} if wait else None
        hub = {"sig": cols["sig"][-1], "salt": cols["salt"][-1]} | {k: hubs[k][-1] for k in hubs}


def _restrict(docs: DataFrame, ids: DataFrame, how: str, on: str, entries: int | None = None) -> DataFrame:
    """Join with a table of identifiers: sent to all tasks if counted small, else shuffled."""
    small = (ids.count() if entries is None else entries) <= SENT_IDS
    return docs.join(F.broadcast(ids) if small else ids, on, how)


def _send_sets(width: int):
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("role", pa.int32()), ("node", pa.int64()), ("shingles", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            rows: list[list] = [[], [], [], [], []]
            size = 0
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            for s, node, meets in zip(sets, batch.column("node").to_pylist(), batch.column("meets").to_pylist()):
                if not len(s) or set_key(s) != node:
                    continue  # another text under the same identifier
                raw = s.tobytes()
                for m in meets:
                    for c, v in zip(rows, (m["key"], m["salt"], m["role"], node, raw)):
                        c.append(v)
                    size += len(raw)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                        rows, size = [[], [], [], [], []], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return work


def _with_node(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_pydict({"node": pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), "text": batch.column("text")})

    return work


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each key's document with those sent to it; rows come sorted by key, salt and role."""
    at, mine = None, None
    for batch in batches:
        a, b = [], []
        for key, salt, role, node, raw in zip(*[batch.column(c) for c in ("key", "salt", "role", "node", "shingles")]):
            where = (key.as_py(), salt.as_py())
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            if role.as_py() == 0:
                at, mine = where, s
                continue
            if where != at:
                continue
            small, large = (s, mine) if len(s) < len(mine) else (mine, s)
            place = np.searchsorted(large, small)
            place[place == len(large)] = 0
            both = int((large[place] == small).sum())
            if 100 * both >= percent * (len(s) + len(mine) - both):
                a.append(node.as_py())
                b.append(where[0])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _compare_sketches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that sketches do not rule out; rows come sorted by key, salt and role."""
    at, mine, m = None, None, 0
    for batch in batches:
        a, b = [], []
        for key, salt, role, node, n, raw in zip(*[batch.column(c) for c in ("key", "salt", "role", "node", "n", "sketch")]):
            where, got = (key.as_py(), salt.as_py()), np.frombuffer(raw.as_buffer(), np.uint8)
            if role.as_py() == 0:
                at, mine, m = where, got, n.as_py()
            elif where == at and may_link(got, n.as_py(), mine, m, percent):
                a.append(node.as_py())
                b.append(where[0])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _meetings(pairs: DataFrame) -> DataFrame:
    """What each node is sent to: itself in role 0 and its partners in role 1, in parts of about ``MEET``."""
    met = Stored(pairs.groupBy("b").agg((F.count("*") / MEET).cast("int").alias("parts")), "met").df
    # pairs are never dealt out by the document that is met; those of more than one part are few
    busy = met.where("parts > 0")
    sent = _restrict(pairs, busy, "left", "b").select(
        F.col("a").alias("node"),
        F.struct(F.col("b").alias("key"), F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(0)) + 1).cast("int").alias("salt"), F.lit(1).alias("role")).alias("m"),
    )
    own = met.select("b", F.explode(F.sequence(F.lit(0), "parts")).alias("salt")).select(F.col("b").alias("node"), F.struct(F.col("b").alias("key"), "salt", F.lit(0).alias("role")).alias("m"))
    return sent.unionByName(own)


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "role")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int = 75) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar.

    Sketches, then the sets of what they leave, are sent to the documents that
    they meet; a document met by many receives them in several places.
    """
    drawn = _meetings(pairs).join(nodes.select("node", "n", "sketch"), "node").select("m.*", "node", "n", "sketch")
    likely = Stored(_met(drawn).mapInArrow(partial(_compare_sketches, percent=percent), "a long, b long"), "likely").df
    meets = _meetings(likely).groupBy("node").agg(F.collect_list("m").alias("meets"))
    wanted = Stored(meets.join(nodes.select("node", F.col("rep").alias("doc_id")), "node"), "meets").df
    named, unnamed = wanted.where("doc_id is not null"), wanted.where("doc_id is null")
    entries = named.agg(F.sum(F.size("meets"))).first()[0] or 0
    texts = _restrict(docs, named, "inner", "doc_id", entries).select("node", "meets", "text")
    if not unnamed.isEmpty():  # texts of which no row has an identifier are found by their sets
        bare = docs.where("doc_id is null").mapInArrow(_with_node(width), "node long, text string").dropDuplicates(["node"])
        texts = texts.unionByName(bare.join(unnamed, "node").select("node", "meets", "text"))
    sets = texts.mapInArrow(_send_sets(width), "key long, salt int, role int, node long, shingles binary")
    return _met(sets).mapInArrow(partial(_compare, percent=percent), "a long, b long")


def _other_pairs(batches: Iterator[pa.RecordBatch], percent: int, first: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile that lie in different components and may be linked.

    Rows come sorted by signature, tile and role: first those of any but the
    tile's largest component, then those they may be linked with. With ``first``,
    which compares the nodes' marks, a pair is listed by its first signature only.
    """
    names = ["node", "component", "n", "most"]
    ask: list[dict] = []
    at = None

    def minis(raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(x.ljust(MINI, b"\0") for x in raw), np.uint8).reshape(len(raw), MINI)

    for batch in batches:
        where = list(zip(*[batch.column(c).to_pylist() for c in ("sig", "i", "j", "role")]))
        cols = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
        raw, main = batch.column("mini").to_pylist(), batch.column("main").to_numpy(zero_copy_only=False)
        cuts = [0, *[k for k in range(1, len(where)) if where[k] != where[k - 1]], len(where)] if where else [0]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if where[s][:3] != at:
                at, ask = where[s][:3], []
            got = {k: v[s:e] for k, v in cols.items()} | {"mini": minis(raw[s:e]), "size": np.array([len(x) for x in raw[s:e]]), "main": main[s:e]}
            if first:
                got["mark"] = np.frombuffer(b"".join(batch.column("mark").slice(s, e - s).to_pylist()), np.uint32).reshape(e - s, -1)
            if where[s][3] == 0:
                ask.append(got)
                continue
            for q in ask:
                for x in range(len(q["node"])):
                    n, m = q["n"][x], got["n"]
                    # if neither lies in the largest component, both ask: once is enough
                    y = np.flatnonzero(
                        (got["component"] != q["component"][x]) & (got["most"] >= n) & (m <= q["most"][x]) & (100 * n >= percent * m) & (100 * m >= percent * n) & (got["main"] | (got["node"] > q["node"][x]))
                    )
                    if len(y) and first:
                        y = y[first(got["mark"][y], q["mark"][x], where[s][0])]
                    if len(y):
                        apart = _apart(got["mini"][y], q["mini"][x], np.minimum(got["size"][y], q["size"][x]))
                        y = y[(100 + percent) * apart <= (100 - percent) * (m[y] + n)]
                    if len(y):
                        a, b = np.full(len(y), q["node"][x]), got["node"][y]
                        yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})


def _apart(rows: np.ndarray, one: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits in which sketches, filled up with zeros, differ after both are folded to ``sizes`` bytes."""
    out = np.empty(len(rows), np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = np.bitwise_xor.reduce((rows[at] ^ one).reshape(len(at), -1, size), axis=1)
        out[at] = np.bitwise_count(x).sum(1, dtype=np.int64)
    return out


def _tiles(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of signatures that join several components, dealt out in tiles of bounded size.

    Within a signature, rows outside its largest component are compared with all
    rows. Both sides are cut into parts of about ``TILE`` rows; a tile is a pair
    of parts, so that no signature has to fit into a task.
    """
    sizes = marked.groupBy("sig", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("sig").agg(F.sum("k").alias("k"), F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("c"))
    mixed = largest.where("c > 1 and k > 2").select(
        "sig", F.col("top.component").alias("main"), (F.col("k") / TILE).cast("int").alias("across"), ((F.col("k") - F.col("top.k")) / TILE).cast("int").alias("down")
    )
    rest = marked.where("not done").join(Stored(mixed, "mixed").df, "sig")
    # a bucket's first document has met all others there, but for those of other buckets
    mark = [c for c in ("mark",) if c in nodes.columns]
    rest = rest.join(nodes.select("node", "sketch", *mark), "node").withColumn("mini", _fold("sketch"))
    plain = ["sig", "node", "component", "n", "most", "mini", *mark, (F.col("component") == F.col("main")).alias("main")]
    spot = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), F.col(c) + 1).cast("int")
    asks = rest.where("component <> main").select(*plain, spot("down").alias("i"), F.explode(F.sequence(F.lit(0), "across")).alias("j"), F.lit(0).alias("role"))
    meets = rest.select(*plain, F.explode(F.sequence(F.lit(0), "down")).alias("i"), spot("across").alias("j"), F.lit(1).alias("role"))
    return asks.unionByName(meets).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "role")


def _fold(column: str):
    @F.pandas_udf("binary")
    def fold(sketches: pd.Series) -> pd.Series:
        return sketches.map(folded)

    return fold(F.col(column))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Two documents are linked when their shingle sets have a Jaccard similarity of
    at least 0.75; the component is the smallest identifier reachable by links.
    Null and empty texts have no shingles and are linked with nothing; rows with
    equal sets are one node whatever their identifiers, so that repeated rows are
    harmless; null identifiers never name a component unless all of it is null.
    An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    slim = slim_documents(docs, id_col, text_col)
    first = Stored(slim.mapInArrow(_counts("doc_id", "text", width), "doc_id long, n_shingles long, node long, sketch binary, block int, counts binary"), "counts")
    bits = frequent_counters(first.df.where("block is not null"))
    rows = first.df.where("block is null").select("doc_id", "n_shingles", "node")
    alike = first.df.where("node is not null").groupBy("node")
    nodes = Stored(alike.agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")), "nodes").df
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    # rows of whose identifier no node is represented need not be read again
    copies = rows.select("doc_id").distinct().join(nodes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    posted = _restrict(slim, copies, "left_anti", "doc_id").mapInArrow(_postings("text", width, sent), "sig long, salt int, rare int, node long, n int, most int")
    return linked_components(slim, rows, nodes, posted, width, 75)


def slim_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier and text alone."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def linked_components(docs: DataFrame, rows: DataFrame, nodes: DataFrame, posted: DataFrame, width: int, percent: int, first: Callable | None = None) -> DataFrame:
    """``rows`` with the component of each, from the signatures that nodes have posted.

    Nodes that share a signature are verified by their whole sets, first with one
    of each bucket, then whatever lies in different components. ``first`` tells
    from the marks of two nodes whether a signature is the first that they share.
    """
    near = posted.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "rare", "node")
    shape = "sig long, salt int, node long, n int, most int, hub_node long, hub_n int, hub_most int"
    kept = Stored(near.mapInArrow(_buckets, shape), "buckets").df

    # parts of a signature of frequent shingles meet through the least of their first documents
    firsts = kept.where("salt >= 0").select("sig", "hub_node", "hub_n", "hub_most").distinct()
    top = firsts.groupBy("sig").agg(F.min("hub_node").alias("t"))
    parts = firsts.join(top, "sig").where("hub_node <> t").select(F.col("hub_node").alias("a"), F.col("t").alias("b"))
    fits = f"node <> hub_node and n <= hub_most and hub_n <= most and 100 * n >= {percent} * hub_n and 100 * hub_n >= {percent} * n"
    pairs = Stored(kept.where(fits).select(F.col("node").alias("a"), F.col("hub_node").alias("b")).unionByName(parts).distinct(), "pairs").df
    links = Stored(verified(docs, nodes, pairs, width, percent), "links").df
    found = Stored(components(links), "components").df

    # what is left: documents of different components that share a signature but not its first document
    done = F.expr("salt < 0 and node = hub_node").alias("done")
    marked = kept.join(found, "node", "left").select("sig", "node", "n", "most", done, F.coalesce("component", "node").alias("component"))
    marked = Stored(marked, "marked").df
    others = _tiles(marked, nodes).mapInArrow(partial(_other_pairs, percent=percent, first=first), "a long, b long").distinct()
    more = Stored(others, "others").df
    if not more.isEmpty():
        late = Stored(verified(docs, nodes, more, width, percent), "late").df
        if not late.isEmpty():
            found = Stored(components(links.unionByName(late)), "components").df
    named = nodes.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "component").select("node", "component_id")
    return rows.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
