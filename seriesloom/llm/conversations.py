"""Conversation repair: cheapest edits on a lattice of turns and grammar states.

A repaired conversation's role initials follow ``(s?(ua)+)?``. Nodes of the
lattice are (turns read, grammar state); edges keep, rerole, delete or insert a
turn. Dijkstra's algorithm explores it with the priority (cost, audit), the
audit being the initials of the edits so far, and stops at the first accepting
end node it pops. Two paths to one node with equal cost are never prefixes of
each other (they read the same turns, and an extra insertion costs), so the
least key at each node is final.

No conversation has to fit into a task. Rows are numbered by a range partitioning
on conversation and turn, so that a conversation of any length lies in many
tasks; there each piece yields the cheapest paths from each entry state to each
exit state, and pieces are composed along the conversation. Only what SHA-256
demands, to read a conversation's text in order, runs through one task for each
conversation, as a stream with a state of fixed size and the audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, pick, small_batches

#: Costs of the edits, and what a truncated turn adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a piece at most.
PIECE = 1024
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = "0sua"
ENDS = frozenset("0a")
#: The state after a turn's initial, if the grammar allows it there.
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: The role that may be inserted or rewritten in each state.
WANTED = {"0": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: White space, as in the contract of the words.
_SPACE = r"\x20\x09-\x0D"

Path = tuple[int, str]


def _explore(turns: str, entry: str, wanted: frozenset[str], all_of: bool) -> dict[str, Path]:
    """Cheapest paths over coded turns from an entry state to end nodes in wanted states.

    ``turns`` has one character for each: the role's initial (x for any other),
    a capital if truncated, or d if the turn must go. With ``all_of`` the search
    goes on until every wanted state that can be reached is popped; otherwise it
    stops at the first.
    """
    n = len(turns)
    heap = [(0, "", 0, entry)]
    done: set[tuple[int, str]] = set()
    found: dict[str, Path] = {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == n and state in wanted:
            found[state] = (cost, audit)
            if not all_of or len(found) == len(wanted):
                break
        want = WANTED[state]
        if (at, want) not in done:
            heapq.heappush(heap, (cost + INSERT, audit + "I", at, want))
        if at == n:
            continue
        turn = turns[at]
        heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
        if turn != "d":
            more = TRUNCATED if turn.isupper() else 0
            kept = NEXT.get((state, turn.lower()))
            if kept:
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, kept))
            heapq.heappush(heap, (cost + REROLE + more, audit + "R", at + 1, want))
    return found


@lru_cache(1 << 15)
def cheapest(turns: str) -> Path:
    """Cost and audit of a whole conversation's repair."""
    return next(iter(_explore(turns, "0", ENDS, False).values()))


@lru_cache(1 << 12)
def piece_paths(turns: str, entry: str) -> dict[str, Path]:
    """Cheapest paths over a piece from an entry state to every state that can be reached."""
    # nothing leads back to the start, and the state after the system turn follows it alone
    reach = {"0": "0sua", "s": "sua"}.get(entry, "ua")
    if entry == "0" and not any(t in "sS" for t in turns):
        reach = "0ua"
    return _explore(turns, entry, frozenset(reach), True)


def compose(before: dict[str, Path], piece: dict[tuple[str, str], Path]) -> dict[str, Path]:
    """Cheapest paths up to the end of a piece, from those up to its start."""
    out: dict[str, Path] = {}
    for (entry, leave), (cost, audit) in piece.items():
        if entry in before:
            new = (before[entry][0] + cost, before[entry][1] + audit)
            if leave not in out or new < out[leave]:
                out[leave] = new
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that ``crc32(conv_id:turn) % 20`` names; other columns are dropped.

    0 drops the row, 1 empties its text, 2 removes the marks ``.!?`` from it, 3
    repeats the row, 4 sets the role to user. Null roles and texts become one
    space, as do null identifiers and turns inside the hashed key.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = pick(conversations, "conv_id", "turn", "role", "text")
    slim = slim.withColumn("hit", F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20)
    changed = slim.where("hit <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    )
    return changed.drop("again")


def _prepared(turns: DataFrame) -> DataFrame:
    """Rows with what orders them: turn, role, start of the text and a digest of role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    slim = pick(turns, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return slim.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", digest)


def _code() -> tuple[Column, Column]:
    """The role's initial, and the fault that the text alone shows: b blank, t truncated, else empty."""
    initial = F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("x")
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    whole = F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    return initial, F.when(blank, "b").when(~whole, "t").otherwise("")


_PIECE = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("initials", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "least", "most", "distinct", "first", "last")],
        T.StructField("whole", T.BooleanType()),
        T.StructField("paths", T.ArrayType(T.StructType([T.StructField("entry", T.StringType()), T.StructField("leave", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))),
    ]
)
_LEGAL = frozenset(("su", "ua", "au"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations with their counts and cheapest paths; rows come sorted by place."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_PIECE)
    for batch in batches:
        convs, turns, places = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "place"))
        initials, faults = batch.column("initial").to_pylist(), batch.column("fault").to_pylist()
        n = len(convs)
        cuts = [0, *[i for i in range(1, n) if convs[i] != convs[i - 1]], n]
        rows = []
        for c in range(len(cuts) - 1):
            # the first and the last conversation of a batch may go on elsewhere
            sure = 0 < c < len(cuts) - 2 and cuts[c + 1] - cuts[c] <= PIECE
            for s in range(cuts[c], cuts[c + 1], PIECE):
                e = min(s + PIECE, cuts[c + 1])
                marks, letters = faults[s:e], initials[s:e]
                coded = "".join("d" if f in ("b", "r") else i.upper() if f == "t" else i for i, f in zip(letters, marks))
                known = [t for t in turns[s:e] if t is not None]
                if sure:
                    cost, audit = cheapest(coded)
                    paths = [{"entry": "0", "leave": "", "cost": cost, "audit": audit}]
                else:
                    paths = [{"entry": x, "leave": y, "cost": p[0], "audit": p[1]} for x in STATES for y, p in piece_paths(coded, x).items()]
                rows.append(
                    {
                        "conv_id": convs[s],
                        "place": places[s],
                        "initials": letters[0] + letters[-1],
                        "blank": marks.count("b"),
                        "duplicate": marks.count("r"),
                        "truncated": marks.count("t"),
                        "illegal": sum(a + b not in _LEGAL for a, b in zip(letters, letters[1:])),
                        "least": known[0] if known else None,
                        "most": known[-1] if known else None,
                        "distinct": len(set(known)),
                        "first": turns[s],
                        "last": turns[e - 1],
                        "whole": sure,
                        "paths": paths,
                    }
                )
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


_FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces; these come sorted by conversation and place."""
    open_conv: list = []  # at most one: the state of the conversation that is read
    out: list[dict] = []

    def close() -> None:
        c = open_conv.pop()
        cost, audit = min(p for s, p in c["paths"].items() if s in ENDS or s == "")
        gaps = c["most"] - c["least"] + 1 - c["distinct"] if c["least"] is not None else 0
        out.append({k: c[k] for k in ("conv_id", *_COUNTS)} | {"gaps": gaps if gaps < 1 << 63 else None, "cost": cost, "audit": audit})

    names = ("conv_id", "gaps", *_COUNTS, "cost", "audit")
    kinds = (*[pa.int64()] * 7, pa.string())
    schema = pa.schema(list(zip(names, kinds)))
    for batch in batches:
        for p in batch.to_pylist():
            paths = {(x["entry"], x["leave"]): (x["cost"], x["audit"]) for x in p.pop("paths")}
            if open_conv and open_conv[0]["conv_id"] != p["conv_id"]:
                close()
            if not open_conv:
                open_conv.append(p | {"paths": compose({"0": (0, "")}, paths)})
                continue
            c = open_conv[0]
            for k in _COUNTS:
                c[k] += p[k]
            c["illegal"] += c["initials"][-1] + p["initials"][0] not in _LEGAL
            if p["least"] is not None:
                c["least"] = p["least"] if c["least"] is None else c["least"]
                c["distinct"] += p["distinct"] - (p["first"] is not None and p["first"] == c["last"])
                c["most"] = p["most"]
            c["last"], c["initials"] = p["last"], p["initials"]
            c["paths"] = compose(c["paths"], paths)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    if open_conv:
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost and audit of every conversation that has rows; texts are not shuffled."""
    initial, fault = _code()
    light = rows.select("conv_id", "turn", "role", "head", "digest", initial.alias("initial"), fault.alias("fault"))
    # equal rows of one turn cannot be told apart by their values: the last key spreads them
    keys = ["conv_id", "turn", "role", "head", "digest", "n"]
    dealt = light.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = Stored(dealt.select("conv_id", "turn", "digest", "initial", "fault", F.monotonically_increasing_id().alias("place")), "turns")
    firsts = placed.df.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("fresh"))
    fault = F.when(F.col("fault") == "b", "b").when(F.col("fresh").isNull(), "r").otherwise(F.col("fault"))
    marked = placed.df.join(firsts, "place", "left").select("conv_id", "turn", "place", "initial", fault.alias("fault"))
    pieces = marked.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(_pieces, _PIECE)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_composed, _FOUND)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, int | None, str, str]]]]:
    """Conversations as header rows with an iterator over their repaired turns (edit, turn, role, text).

    Rows come sorted: a header with the audit first, then the turns in order.
    """
    rows = (r for batch in batches for r in batch.to_pylist())
    waiting = next(rows, None)

    def lines(header: dict) -> Iterator[tuple[str, int | None, str, str]]:
        nonlocal waiting
        state = "0"
        for edit in header["audit"]:
            if edit != "I":
                row, waiting = waiting, next(rows, None)
            if edit == "D":
                continue
            if edit == "K":
                state = NEXT[state, row["role"][0]]
                yield edit, row["turn"], row["role"], row["text"]
                continue
            state = WANTED[state]
            yield edit, row["turn"] if edit == "R" else None, ROLES[state], row["text"] if edit == "R" else ""

    while waiting is not None:
        header, waiting = waiting, next(rows, None)
        yield header, lines(header)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    schema = pa.schema([*[(c, pa.int64()) for c in ("conv_id", "gaps", *_COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for header, lines in _edited(batches):
        h = hashlib.sha256()
        for number, (_, _, role, text) in enumerate(lines):
            h.update((("\n" if number else "") + f"{role}:{text}").encode())
        out.append((*[header[n] for n in schema.names[:-1]], h.hexdigest()))
        if len(out) == 1024:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out: list[dict] = []
    for header, lines in _edited(batches):
        for number, (edit, turn, role, text) in enumerate(lines):
            out.append({"conv_id": header["conv_id"], "position": number, "edit": edit, "turn": turn, "role": role, "text": text})
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Headers and turns of each conversation, sorted for ``_edited``."""
    keys = ["conv_id", "turn", "role", "head", "digest"]
    body = turns.select(*keys, "text", F.lit(1).alias("kind"))
    both = body.unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *keys[1:]).drop("kind", "head", "digest")


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; ``ids`` names
    more conversations (a column ``conv_id``) that may have no rows. Null roles
    and texts are one space. A conversation is read by turn, nulls first; rows
    of one turn by role, the first 64 characters and a digest of the text. A null ``conv_id`` is
    one conversation of its own. Columns: ``conv_id``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``,
    ``repaired_sha256``. Conversations without rows have zeros, an empty audit
    and the hash of an empty text; gaps beyond a long are null; an empty table
    gives an empty result; other columns are ignored.
    """
    small_batches(turns.sparkSession)
    rows = _prepared(turns)
    found = audits(rows)
    if ids is not None:
        every = pick(ids, "conv_id").select(F.col("conv_id").cast("long").alias("id")).distinct()
        got = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
        zero = [F.coalesce(F.when(F.col("audit").isNotNull(), F.col(c)).otherwise(F.lit(0)), F.lit(None)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
        found = got.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"))
    return _with_audits(rows, found).mapInArrow(_digests, f"{_FOUND}, repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``position`` from 0, ``edit`` (K, R or I), ``turn`` (null if inserted), ``role`` and ``text``.

    Input and defined cases are those of ``repair_conversations``; conversations
    of which every turn goes have no rows.
    """
    small_batches(turns.sparkSession)
    rows = _prepared(turns)
    return _with_audits(rows, audits(rows)).mapInArrow(_repaired, "conv_id long, position long, edit string, turn long, role string, text string")
