"""Words, word hashes and window hashes of many texts at once, over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Multipliers of the hash functions: odd 64-bit numbers.
STEP = U64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * MIX_A
    h = h ^ (h >> U64(27))
    h = h * MIX_B
    return h ^ (h >> U64(31))


@cache
def byte_values(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U64) + U64(seed << 16)) * STEP) | U64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = _powers(max(n, 2 * len(_POWERS)))
    return _POWERS[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary array; nulls are empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def parts(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of rows lo..hi: start and end in data, row of each (from 0), first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.n_rows = len(offsets) - 1
        isw = ~separators[self.data]
        first = isw.copy()
        first[1:] &= ~isw[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = isw[heads]
        self.starts = np.flatnonzero(first)
        self.inside = isw
        last = isw.copy()
        last[:-1] &= ~isw[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.row_first = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(self.n_rows), np.diff(self.row_first))
        self.counts = np.diff(self.row_first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, U64)
        lens = self.ends - self.starts
        ends = np.cumsum(lens)
        begin = ends - lens
        body = self.data[self.inside]
        at = np.arange(len(body)) - np.repeat(begin, lens)
        values = byte_values(seed)[body] * powers(int(lens.max()))[at]
        return mix(np.add.reduceat(values, begin) + lens.astype(U64) * MIX_B)


def windows(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words, and where such windows start (only windows within a row)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= STEP
        out += h[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(out[at]), at


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, start + width)."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(steps[:n]) > 0
