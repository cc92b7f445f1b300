"""Sets of hashed word shingles, many texts at a time."""

from __future__ import annotations

import numpy as np

#: Fixed odd base of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; longer texts go in overlapping parts. A worker keeps 16 bytes for each.
PART = 1 << 19

_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < size:
        n = 1 << max(16, (size - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
        _POWERS["bytes"] = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _POWERS["up"], _POWERS["down"], _POWERS["bytes"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _hash_parts(parts: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    """Hashes of the shingles of each part; words in a part have one blank between them."""
    data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    up, down, by = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(by[data] * up[: len(data)], out=sums[1:])
    blanks = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(data)]])
    out, at = [], 0
    for n in counts:
        k = max(1, n - width + 1)
        s, e = starts[at : at + k], ends[at + min(width, n) - 1 : at + min(width, n) - 1 + k]
        out.append(mixed((sums[e] - sums[s]) * down[s]))
        at += n
    return out


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A-Z are lower-cased and words are runs of anything but blanks and the
    characters 9 to 13. A text with fewer than ``width`` words has its whole
    sequence as one shingle; one without words, or null, has none.
    """
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    parts, counts, owner, size = [], [], [], 0
    found: dict[int, list[np.ndarray]] = {}

    def flush() -> None:
        nonlocal parts, counts, owner, size
        if parts:
            for i, h in zip(owner, _hash_parts(parts, counts, width)):
                found.setdefault(i, []).append(h)
        parts, counts, owner, size = [], [], [], 0

    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        step = len(words) if len(text or "") < PART else 100_000
        for at in range(0, len(words), max(1, step)):
            piece = words[at : at + step + width - 1] if step < len(words) else words
            if at and len(piece) < width:
                break
            parts.append(b" ".join(piece))
            counts.append(len(piece))
            owner.append(i)
            size += len(parts[-1])
            if size > PART:
                flush()
    flush()
    for i, hs in found.items():
        h = np.sort(hs[0] if len(hs) == 1 else np.concatenate(hs))
        out[i] = h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h
    return out


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a set; equal sets have equal keys."""
    import xxhash

    v = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return v - (1 << 64) if v >> 63 else v
