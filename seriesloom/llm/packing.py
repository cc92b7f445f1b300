"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece whose length lies in ``(C/(k+1), C/k]`` belongs to class ``k``, and a
sequence of class ``k`` takes exactly ``k`` pieces, so each task fills its
sequences without knowing any other task's documents. As documents may be cut,
whole sequences are cut off first, and the rest is cut at class sizes until what
remains is short, which leaves little of a sequence unfilled.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pick, release_memory, small_batches, text_slices

#: A rest of at most this many tokens is not cut further.
SHORT = 256
#: Words and other chunks between spaces kept with their ids by each Python worker: those met last.
CACHE_CHUNKS = 240_000
CACHE_CHARS = 48
#: Bytes of texts encoded at once; the memory that it took goes back after each slice.
SLICE_BYTES = 1 << 20

#: Marks that often end a word, and words that certainly are letters to the tokenizer; patterns of Arrow's regular expressions.
_LETTERS = "[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
WORD, MARKED = rf"\A{_LETTERS}\z", rf"\A{_LETTERS}[.,!?]\z"

_ENCODERS: dict = {}


def lists(sizes: np.ndarray, values: np.ndarray) -> pa.LargeListArray:
    """Lists of these sizes, one after the other in ``values``."""
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.array(values, pa.uint32()))


class ChunkEncoder:
    """Ids of texts.

    The word tokenizer drops white space and never joins characters across it,
    so the ids of a text are those of its chunks between spaces, one after the
    other. The distinct chunks of many texts are looked up together; those met
    lately are kept with their ids. They are held as Arrow arrays, as Python
    objects for each would take ten times their size in every worker.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # lower-case composed letters need no normaliser, and words between blanks no pattern
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # added tokens are told apart by case before the normaliser sees a text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.known_ids = pa.array([], pa.string()), lists(np.array([], int), np.array([], "<u4"))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")

    def _words(self, words: pa.Array) -> Iterator[pa.LargeListArray]:
        """Ids of words of letters, many in one text: the last token of each is marked as a word's end."""
        for start in range(0, len(words), 4_000):
            part = words.slice(start, 4_000).to_pylist()
            ids = np.array(self.plain.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, dtype="<u4")
            sizes = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(sizes) != len(part) or sizes.sum() != len(ids):
                raise ValueError(f"{len(part)} words gave {len(sizes)} ends")
            yield lists(sizes, ids)

    def _chunks(self, chunks: pa.Array) -> Iterator[pa.LargeListArray]:
        for start in range(0, len(chunks), 4_000):
            found = self.tokenizer.encode_batch_fast(chunks.slice(start, 4_000).to_pylist(), add_special_tokens=False)
            ids = [np.array(enc.ids, "<u4") for enc in found]
            yield lists(np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids))

    def _looked_up(self, chunks: pa.Array) -> pa.LargeListArray:
        """Ids of distinct chunks, which become those met last."""
        import pyarrow.compute as pc

        known = self.known.cast(chunks.type)
        at = pc.index_in(chunks, value_set=known)
        new = chunks.filter(at.is_null())
        is_word = pc.and_(pc.match_substring_regex(new, WORD), pc.less_equal(pc.utf8_length(new), CACHE_CHARS))
        words, other = new.filter(is_word), new.filter(pc.invert(is_word))
        base = pa.concat_arrays([self.known_ids, *self._words(words), *self._chunks(other)])
        place, mask = np.empty(len(new), np.int64), np.asarray(is_word)
        place[mask] = len(known) + np.arange(len(words))
        place[~mask] = len(known) + len(words) + np.arange(len(other))
        rest = np.ones(len(known), bool)
        rest[np.asarray(at.drop_null())] = False
        where = np.asarray(at.fill_null(-1)).astype(np.int64)
        where[where < 0] = place
        short = np.asarray(pc.less_equal(pc.utf8_length(chunks), CACHE_CHARS))
        ids = base.take(pa.array(where))
        kept = np.concatenate([where[short], np.flatnonzero(rest)])[:CACHE_CHUNKS]
        self.known = pa.concat_arrays([chunks.filter(pa.array(short)), known.filter(pa.array(rest))])[:CACHE_CHUNKS]
        self.known_ids = base.take(pa.array(kept))
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's end."""
        import pyarrow.compute as pc

        # A-Z may be lowered beforehand: the tokenizer lowers all letters, and this changes no composition;
        # not where lowering would make up an added token
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        lowered = pc.ascii_lower(texts)
        for token in self.added:
            lowered = pc.if_else(pc.match_substring(lowered, token.lower()), texts, lowered)
        split = pc.split_pattern(lowered, " ")
        in_text = np.concatenate([[0], np.cumsum(pc.list_value_length(split), dtype=np.int64)])
        coded = split.flatten().dictionary_encode()
        del texts, lowered, split
        # a word and the mark that ends it are parts of their own
        chunks, at = coded.dictionary, np.asarray(coded.indices)
        marked = pc.match_substring_regex(chunks, MARKED)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, -1), "")
        parts = pa.concat_arrays([stems, marks.cast(stems.type)]).dictionary_encode()
        ids = self._looked_up(parts.dictionary)
        pairs = ids.take(pa.array(np.asarray(parts.indices).reshape(2, -1).T.ravel()))
        by_chunk = pa.LargeListArray.from_arrays(pa.array(np.asarray(pairs.offsets)[::2]), pairs.values)
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(by_chunk))[at], dtype=np.int64)])
        return np.asarray(by_chunk.take(pa.array(at)).flatten()), ends[in_text[1:]]


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def cut_points(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document."""
    pieces = [(s, capacity) for s in range(0, tokens - capacity + 1, capacity)]
    start = len(pieces) * capacity
    rest = tokens - start
    while rest > SHORT:
        size = capacity // -(-capacity // rest)
        pieces.append((start, size))
        start += size
        rest -= size
    if rest:
        pieces.append((start, rest))
    return pieces


class Bins:
    """Open sequences of one task: one for each class, the rest by best fit at the end."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _placed(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for p in pieces:
            out.append((*p, self.next_id, offset))
            offset += p[2]
        self.next_id += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return []
        self.open[k] = []
        return self._placed(held)

    def finish(self) -> Iterator[tuple]:
        """Pieces of unfilled classes, largest first, each into the fullest sequence that takes it."""
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        room: list[tuple[int, int]] = []  # (free tokens, index), ascending
        bins: list[list[tuple]] = []
        for p in rest:
            at = bisect_left(room, (p[2], -1))
            if at < len(room):
                free, index = room.pop(at)
            else:
                free, index = self.capacity, len(bins)
                bins.append([])
            bins[index].append(p)
            if free > p[2]:
                insort(room, (free - p[2], index))
        for held in bins:
            yield from self._placed(held)


def harmonic_pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document with their places in sequences.

    Null text counts as empty and yields the end id alone; a null identifier is
    kept. Repeated rows are packed as documents of their own, an empty table
    gives no piece, other columns are ignored. Columns: ``doc_id``, ``start``,
    ``length``, ``ids_crc32`` (over little-endian unsigned 32-bit ids),
    ``doc_tokens``, ``sequence_id``, ``offset``, and ``ids`` if ``with_ids``.
    There is no shuffle; sequence ids carry the task's number in their high bits.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ddl = ", ".join(f"{n} long" for n in names) + (", ids binary" if with_ids else "")
    schema = pa.schema([(n, pa.int64()) for n in names] + ([("ids", pa.binary())] if with_ids else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        enc = encoder(tokenizer_path)
        out: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            # piece tuples hold: id, start, length, crc, tokens, ids, sequence, offset
            arrays = [pa.array(cols[i], pa.int64()) for i in (0, 1, 2, 3, 4, 6, 7)]
            return pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[5], pa.binary())] if with_ids else []), schema=schema)

        for batch in text_slices(batches, text_col, SLICE_BYTES):
            ids = batch.column(id_col).to_pylist()
            found, ends = enc.encode(batch.column(text_col))
            with_end = np.insert(found, ends, end_id)
            raw, at = memoryview(with_end.astype("<u4", copy=False)).cast("B"), 0
            for doc, stop in zip(ids, (ends + np.arange(1, len(ends) + 1)).tolist()):
                total = stop - at
                for start, size in cut_points(total, capacity):
                    piece = raw[4 * (at + start) : 4 * (at + start + size)]
                    out += bins.add((doc, start, size, zlib.crc32(piece), total, bytes(piece) if with_ids else None))
                at = stop
            del found, with_end, raw
            release_memory()
            if len(out) > 20_000:
                yield flush(out)
                out = []
        for row in bins.finish():
            out.append(row)
            if len(out) > 20_000:
                yield flush(out)
                out = []
        if out:
            yield flush(out)

    return pick(docs, id_col, text_col).mapInArrow(work, ddl)
