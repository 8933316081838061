"""Whole-batch tokenising of Arrow text columns in numpy.

A word is a maximal run of bytes other than blank, tab, line feed, vertical
tab, form feed and carriage return; only A-Z are lower-cased, so working on
UTF-8 bytes equals working on characters.  Everything is computed for a block
of documents at once: word borders from byte masks, 64-bit word hashes from
prefix sums of ``table[byte] * base**position`` (taken back to the word's
start with the inverse power), word shapes from runs of character classes.
Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # text handled at once; one longer document is a block of its own

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, b in (("up", _BASE), ("down", _INV)):
            p = np.full(size, b, _U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n+1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` with their bytes and offsets, about ``limit`` bytes at a time."""
    data, off = text_bytes(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


class Words:
    """Word borders of a block: ``start``/``end`` byte positions, ``off``: word ranges of the rows."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, n = data, len(data)
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = off[:-1][off[1:] > off[:-1]]
        first[full] = inside[full]
        full = off[1:][off[1:] > off[:-1]] - 1
        last[full] = inside[full]
        self.inside, self.first = inside, first
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, off)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each lower-cased word."""
        if not len(self.start):
            return np.zeros(0, _U)
        up, down = _powers(len(self.data))
        total = np.cumsum(_TABLE[_LOWER[self.data]] * up, dtype=_U)
        return _spans(total, self.start, self.end, down)

    def spelled(self, which: np.ndarray) -> list[bytes]:
        """The lower-cased words at the given places."""
        raw = self.data.tobytes().lower()
        return [raw[s:e] for s, e in zip(self.start[which].tolist(), self.end[which].tolist())]

    def stems(self, size: int = 6) -> np.ndarray:
        """64-bit hash of the first ``size`` bytes of each lower-cased word."""
        if not len(self.start):
            return np.zeros(0, _U)
        up, down = _powers(len(self.data))
        total = np.cumsum(_TABLE[_LOWER[self.data]] * up, dtype=_U)
        return _spans(total, self.start, np.minimum(self.end, self.start + size), down)

    def shapes(self) -> np.ndarray:
        """64-bit hash of each word's shape: runs of a, A and 0 written once, other bytes kept."""
        if not len(self.start):
            return np.zeros(0, _U)
        cls = _CLASS[self.data]
        runs = self.first.copy()
        runs[1:] |= cls[1:] != cls[:-1]
        runs &= self.inside
        at = np.flatnonzero(runs)
        up, down = _powers(len(at))
        total = np.cumsum(_TABLE[cls[at]] * up, dtype=_U)
        lo = np.searchsorted(at, self.start)
        hi = np.append(lo[1:], len(at))
        return _spans(total, lo, hi, down)


def _spans(total: np.ndarray, lo: np.ndarray, hi: np.ndarray, down: np.ndarray) -> np.ndarray:
    s = total[hi - 1].copy()
    s[lo > 0] -= total[lo[lo > 0] - 1]
    return mix(s * down[lo] + (hi - lo).astype(_U) * _U(0xD6E8FEB86659FD93))


class WordIndex:
    """Numbers of given words, looked up by word hash for whole blocks; -1 for any other word.

    Hashes are kept sorted; a table over their leading bits tells where to
    start, and the few entries that share them are compared one after another.
    Words are identified by their 64-bit hash.
    """

    def __init__(self, words: list[bytes]):
        data, off = text_bytes(pa.array(words, pa.large_binary()))
        w = Words(data, off)
        number = np.flatnonzero(np.diff(w.off))  # an empty string is no word
        h = w.hashes()
        order = np.argsort(h)
        self.hash = np.append(h[order], _U(0xFFFFFFFFFFFFFFFF))
        self.number = np.append(number[order], -1).astype(np.int32)
        self.shift = _U(64 - max(8, min(22, 3 + int(len(h)).bit_length())))
        slots = 1 << (64 - int(self.shift))
        self.first = np.searchsorted(h[order], np.arange(slots, dtype=_U) << self.shift).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        at = self.first[(h >> self.shift).astype(np.int64)]
        got = self.hash[at]
        out = np.where(got == h, self.number[at], np.int32(-1))
        left = np.flatnonzero(got < h)
        while len(left):
            at[left] += 1
            got = self.hash[at[left]]
            same = got == h[left]
            out[left[same]] = self.number[at[left[same]]]
            left = left[got < h[left]]
        return out


def lower_words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words of one text."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()


def word_counts(col: pa.Array) -> np.ndarray:
    """Number of words of each row."""
    out = np.zeros(len(col), np.int64)
    for lo, hi, data, off in blocks(col):
        out[lo:hi] = np.diff(Words(data, off).off)
    return out


def n_words(text):
    """Spark column: number of words of a text column (null: 0)."""
    from pyspark.sql import functions as F

    @F.arrow_udf("long")
    def count(col: pa.Array) -> pa.Array:
        return pa.array(word_counts(col), pa.int64())

    return count(text.cast("binary"))
