"""Token counts from a byte-level BPE vocabulary compiled to transducers.

Two deterministic transducers work one after the other. The first reads classes
of characters and marks where words of the tokenizer start; its rules look at
most two characters to either side. The second reads bytes and returns to its
first state at each mark. Its state after a prefix holds, for every position
from which a vocabulary entry may still be running, the entry's place in the
trie of tokens and the last token of the text before it; two neighbouring tokens
are right exactly if encoding their joined bytes gives the two again, so the
last token of each longer prefix follows from the state, and with it the change
of the token count. Transitions carry that change. They are worked out when
first met and kept in a table, as a lazily built automaton.

Texts are cut into chunks that run side by side. The map of a chunk from entry
state to exit state is constant if it has a mark. Chunks without one have maps
proper, held for the entry states that can occur: a word's start, and the exits of
the chunk before from its own. A parallel prefix scan composes the maps of
neighbouring chunks, doubling the span each time, which gives the entry state of
every chunk at once; where a composed map lacks the state that is needed, the
chunks' maps are extended by the exits that have no image yet, and composed anew.
States forget what lies further back than the last tokens, so that maps have few
entries and one extension mostly does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, small_batches, text_slices

#: Bytes of text in a chunk.
CHUNK = 256
#: Bytes whose chunks run side by side; the table is looked at between them.
SEGMENT = 1 << 20
#: States after which the table is built anew.
MAX_STATES = 120_000
L, N, O, W, SP, AP = 1, 2, 3, 4, 5, 6  # letter, number, other, white space, blank, apostrophe
UNKNOWN, START = 0, 1
ROOT = 0
#: Below a node with at most this many tokens, states that leave the same of them open are one.
FEW = 12

_COMPILED: dict = {}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes(path: str) -> bytes:
    """Class of every code point as the tokenizer's own word splitter sees it."""
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = np.full(0x110000, O, dtype=np.uint8)
    # ideographs and other letters without case make up most assigned characters and are letters to any version
    for m in regex.finditer(r"\p{Lo}+", "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Lo")):
        table[[ord(c) for c in m[0]]] = L
    special = regex.compile(r"[\p{L}\p{N}\s]")
    chars = [c for c in map(chr, range(0x110000)) if (k := unicodedata.category(c)) not in ("Lo", "Cn", "Co", "Cs") or k == "Cn" and special.match(c)]
    for start in range(0, len(chars), 4096):
        part = chars[start : start + 4096]
        codes = np.array([ord(c) for c in part])
        joins = {}
        for mate in "a1!":
            # a character that continues its mate's word starts no word of its own
            text = "".join(mate + c + "\n" for c in part)
            starts = {s for _, (s, _) in split(text)}
            joins[mate] = np.array([3 * i + 1 not in starts for i in range(len(part))])
        table[codes] = np.where(joins["a"], L, np.where(joins["1"], N, np.where(joins["!"], O, W)))
    table[ord(" ")], table[ord("'")] = SP, AP
    return table.tobytes()


def word_starts(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where words start in joined texts; ``first`` marks the texts' first characters."""
    n = len(codes)
    raw = table[codes]
    cls = np.where(raw == AP, O, np.where(raw == SP, W, raw))
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 0, cls[:-1]
    prev[first] = 0
    after_blank = np.zeros(n, bool)
    after_blank[1:] = raw[:-1] == SP
    after_blank[first] = False
    last = np.zeros(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    nxt = np.empty(n, np.uint8)
    nxt[-1], nxt[:-1] = 0, cls[1:]
    nxt[last] = 0
    # a run of white space ends one character early if text follows
    spaces = (cls == W) & ((prev != W) | ((nxt != W) & (nxt != 0)))
    start = np.where(cls == W, spaces, (prev != cls) & ~after_blank)
    at = np.flatnonzero((raw == AP) & (prev != O) & ~after_blank)
    if len(at):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        stop = np.concatenate([first, np.ones(2, bool)])
        one, two = padded[at + 1], padded[at + 2]
        in1 = ~stop[at + 1]
        in2 = in1 & ~stop[at + 2]
        short = in1 & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = in2 & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        for where, size in ((at[short], 2), (at[long & ~short], 3)):
            for k in range(1, size):
                start[where + k] = False
            ends = where + size
            ends = ends[ends < n]
            # what follows a contraction starts anew, save the inner part of a space run
            start[ends[cls[ends] != W]] = True
    start[first] = True
    return start


class Transducer:
    """The byte transducer of one vocabulary with its lazily filled table."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        # numbers follow the order of merges: bytes first, then the result of each merge
        number = {c: i for i, c in enumerate(alphabet)}
        self.tokens = [bytes([alphabet[c]]) for c in number]
        self.halves = [(i, i) for i in range(256)]
        self.merged: dict[int, int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            left, right = number[a], number[b]
            if a + b in number:
                raise ValueError(f"two merges make {a + b!r}")
            number[a + b] = self.merged[left << 20 | right] = len(self.tokens)
            self.tokens.append(self.tokens[left] + self.tokens[right])
            self.halves.append((left, right))
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [False]
        for i, t in enumerate(self.tokens):
            node = ROOT
            for b in t:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token_at[node] = i
        # tokens strictly below each node of the trie, where they are few
        self.below: dict[int, list[int]] = {}
        for i, t in enumerate(self.tokens):
            node = ROOT
            for b in t:
                if node != ROOT:
                    self.below.setdefault(node, []).append(i)
                node = self.child[node << 8 | b]
        self.below = {k: v for k, v in self.below.items() if len(v) <= FEW}
        self.reset()

    def reset(self) -> None:
        self.states: list = [None, (-1, ())]
        self.ids = {(-1, ()): START}
        self.table = np.full((4096, 256), -1, dtype=np.int32)
        self.table[UNKNOWN] = (UNKNOWN << 8) | 128
        self.alike: dict = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are joined.

        Undoes the merges of both, the latest first; the pair is broken if the
        parts then facing each other merge before the one just undone.
        """
        if left < 0:
            return True
        a, b = left, right
        merged, halves = self.merged, self.halves
        limit = 1 << 30
        while True:
            joined = merged.get(a << 20 | b)
            if joined is not None and joined < limit:
                return False
            # of equal merges the left one goes first, hence the 1
            if a > b and a >= 256 or b < 256 <= a:
                limit, a = a, halves[a][1]
            elif b >= 256:
                limit, b = b + 1, halves[b][0]
            else:
                return True

    def stand_in(self, node: int, before: int) -> int | None:
        """The first token met that leaves the same continuations open below ``node``; none if all are shut."""
        few = self.below.get(node)
        if few is None:
            return before
        key = node << 20 | (before + 1)
        if key not in self.alike:
            open_ = tuple([t for t in few if self.fits(before, t)])
            self.alike[key] = self.alike.setdefault((node, open_), before) if open_ else None
        return self.alike[key]

    def step(self, state: int, byte: int) -> int:
        """Packed next state and count change; fills the table."""
        last, live = self.states[state]
        found, running = None, []
        for node, before, rel in (*live, (ROOT, last, 0)):
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            if found is None and (token := self.token_at[nxt]) >= 0 and self.fits(before, token):
                found = (token, rel + 1)
            if self.inner[nxt] and (same := self.stand_in(nxt, before)) is not None:
                running.append((nxt, same, rel))
        token, change = found
        key = (token, tuple((n, b, r - change) for n, b, r in running))
        packed = self.state_of(key) << 8 | (change + 128)
        self.table[state, byte] = packed
        return packed

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Packed transitions of many lanes at once."""
        out = self.table[states, symbols]
        while len(miss := np.flatnonzero(out < 0)):
            for key in np.unique(states[miss].astype(np.int64) << 8 | symbols[miss]).tolist():
                self.step(key >> 8, key & 255)
            out[miss] = self.table[states[miss], symbols[miss]]
        return out

    def state_of(self, key: tuple) -> int:
        """Number of a state."""
        new = self.ids.get(key)
        if new is None:
            new = self.ids[key] = len(self.states)
            self.states.append(key)
            if new >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return new

    def changes(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Change of the token count at every byte; ``marks`` is true at word starts, the first byte's among them."""
        out, entry = [], START
        for at in range(0, len(data), SEGMENT):
            if len(self.states) > MAX_STATES:
                key = self.states[entry]
                self.reset()
                entry = self.state_of(key)
            part, entry = self._segment(data[at : at + SEGMENT], marks[at : at + SEGMENT], entry)
            out.append(part)
        return np.concatenate(out) if out else np.empty(0, np.int8)

    def _segment(self, data: np.ndarray, marks: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Changes in some chunks that start in state ``entry``, and the state after them."""
        n = len(data)
        rows = -(-n // CHUNK)
        pad = rows * CHUNK - n
        grid = np.ascontiguousarray(np.concatenate([data, np.zeros(pad, np.uint8)]).reshape(rows, CHUNK).T)
        heads = np.ascontiguousarray(np.concatenate([marks, np.ones(pad, bool)]).reshape(rows, CHUNK).T)
        out = np.zeros((CHUNK, rows), np.int8)
        state = np.full(rows, UNKNOWN, np.int32)
        at_end = state
        for t in range(CHUNK):
            state[heads[t]] = START
            packed = self.advance(state, grid[t])
            out[t] = (packed & 255) - 128
            state = packed >> 8
            if t == (n - 1) % CHUNK:
                at_end = state
        # a chunk with a mark has a map with one exit only
        first = np.where(heads.any(0), heads.argmax(0), CHUNK)
        exits = np.concatenate([[entry], state]).astype(np.int32)
        todo = np.flatnonzero(first > 0)
        whole = todo[first[todo] == CHUNK]
        # then every chunk's entry state is known, and the bytes before its first mark are run from there
        self._scan(grid, exits, whole)
        self._heads(grid, out, exits[:-1].copy(), exits, first, todo)
        last = int(exits[-1]) if first[-1] == CHUNK else int(at_end[-1])
        if pad and first[-1] == (n - 1) % CHUNK + 1:
            # the last chunk has no mark of its own
            state_at = int(exits[-2])
            for b in data[(rows - 1) * CHUNK :].tolist():
                packed = int(self.table[state_at, b])
                state_at = (packed if packed >= 0 else self.step(state_at, b)) >> 8
            last = state_at
        return out.T.reshape(-1)[:n], last

    def _scan(self, grid: np.ndarray, exits: np.ndarray, whole: np.ndarray) -> None:
        """Exit states of the chunks without a mark, by composing their maps along each run of them; chunk i ends in ``exits[i + 1]``."""
        for run in np.split(whole, np.flatnonzero(np.diff(whole) > 1) + 1):
            if not len(run):
                continue
            into = int(exits[run[0]])
            maps: list[dict[int, int]] = [{} for _ in run]
            ask = {(0, into), *((k, START) for k in range(len(run)))}
            while ask:
                at = sorted(ask)
                for (k, state), leave in zip(at, self._mapped(grid, run[[k for k, _ in at]], np.array([s for _, s in at], np.int32)).tolist()):
                    maps[k][state] = leave
                prefix = prefix_compose(maps)
                if all(into in p for p in prefix):
                    break
                ask = {(k, x) for k in range(1, len(run)) for x in maps[k - 1].values() if x not in maps[k]}
            exits[run + 1] = [p[into] for p in prefix]

    def _mapped(self, grid: np.ndarray, lanes: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Exit states of chunks from entry states."""
        for t in range(CHUNK):
            state = self.advance(state, grid[t, lanes]) >> 8
        return state

    def _heads(self, grid: np.ndarray, out: np.ndarray, entries: np.ndarray, exits: np.ndarray, first: np.ndarray, lanes: np.ndarray) -> None:
        """Apply the maps of ``lanes`` to their entry states: run the bytes before their first marks; lane i ends in ``exits[i + 1]``."""
        if len(lanes) < 16:
            for lane in lanes.tolist():
                state = int(entries[lane])
                for t, b in enumerate(grid[: first[lane], lane].tolist()):
                    packed = int(self.table[state, b])
                    if packed < 0:
                        packed = self.step(state, b)
                    out[t, lane] = (packed & 255) - 128
                    state = packed >> 8
                if first[lane] == CHUNK:
                    exits[lane + 1] = state
            return
        lanes = lanes[np.argsort(-first[lanes], kind="stable")]
        ends = -first[lanes]
        state = entries[lanes]
        for t in range(int(first[lanes[0]])):
            k = int(np.searchsorted(ends, -t, side="left"))
            packed = self.advance(state[:k], grid[t, lanes[:k]])
            out[t, lanes[:k]] = (packed & 255) - 128
            state[:k] = packed >> 8
        whole = first[lanes] == CHUNK
        exits[lanes[whole] + 1] = state[whole]


def compose(first: dict[int, int], then: dict[int, int]) -> dict[int, int]:
    """The map of two neighbouring chunks, as far as theirs reach."""
    return {state: then[x] for state, x in first.items() if x in then}


def prefix_compose(maps: list[dict[int, int]]) -> list[dict[int, int]]:
    """Maps from the first chunk's entry to each chunk's exit: spans are doubled until they reach back to the first."""
    out, span = list(maps), 1
    while span < len(out):
        out = [compose(out[k - span], m) if k >= span else m for k, m in enumerate(out)]
        span *= 2
    return out


def special_strings(path: str) -> tuple[str, ...]:
    """Texts of the file's added tokens, the longest first."""
    with open(path, encoding="utf-8") as f:
        return tuple(sorted((t["content"] for t in json.load(f).get("added_tokens") or []), key=len, reverse=True))


def transducer(path: str) -> Transducer:
    """One transducer for each file and Python worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def count_tokens(machine: Transducer, table: np.ndarray, texts: list[str], special: list[str]) -> list[int]:
    """Tokens of each text; special strings count one each and part what surrounds them."""
    pieces, owner, extra = [], [], [0] * len(texts)
    for i, text in enumerate(texts):
        parts = [text]
        for mark in special:
            if mark in text:
                parts = [x for p in parts for x in p.split(mark)]
        extra[i] = len(parts) - 1
        for p in parts:
            if p:
                pieces.append(p)
                owner.append(i)
    totals = np.array(extra, dtype=np.int64)
    if pieces:
        joined = "".join(pieces)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        lengths = np.array([len(p) for p in pieces])
        first = np.zeros(len(codes), bool)
        first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
        at = np.flatnonzero((data & 0xC0) != 0x80)
        marks = np.zeros(len(data), bool)
        marks[at[word_starts(codes, first, table)]] = True
        change = machine.changes(data, marks)
        sums = np.add.reduceat(change, at[first], dtype=np.int64)
        np.add.at(totals, np.array(owner), sums)
    return totals.tolist()


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    special: tuple[str, ...] | None = None,
) -> DataFrame:
    """Bytes and tokens of every whole text.

    Null and empty texts have no bytes and no tokens; identifiers, null or
    repeated, are passed on row by row; an empty table gives an empty result and
    other columns are ignored. Strings of ``special``, by default the added tokens of the
    tokenizer's file, count one each. The class table of code points, about 1 MB
    whatever the input, is worked out on the driver and sent with the task.
    """
    small_batches(docs.sparkSession)
    classes = character_classes(tokenizer_path)
    special = special_strings(tokenizer_path) if special is None else special
    held = docs.sparkSession.sparkContext.broadcast(classes)
    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        table = np.frombuffer(held.value, dtype=np.uint8)
        for batch in text_slices(batches, text_col, 4 << 20):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            tokens = count_tokens(machine, table, texts, list(special))
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                schema=schema,
            )

    return pick(docs, id_col, text_col).mapInArrow(work, ddl)
