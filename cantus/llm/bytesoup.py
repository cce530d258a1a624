"""Vectorised tokenising of Arrow string columns.

Words are found and hashed on the UTF-8 bytes of a whole slice of documents at
once. A slice holds at most ``SLICE`` bytes, or as many as asked for, unless one text alone is longer, so
memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 2_000_000
#: White space: space and the controls 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R, _RINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, r in enumerate((_R, _RINV)):
            x = np.full(n, r, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Texts ``lo`` to ``hi`` of a column: lower-cased bytes, and the words in them."""

    lo: int
    hi: int
    data: np.ndarray  # bytes, A-Z lower-cased
    at: np.ndarray  # byte offset of each text, one more at the end
    start: np.ndarray  # of words
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, one more at the end

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        p, inv = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        x = total[1:]  # in place: eight bytes a byte of text are the most that is held here
        x[:] = self.data
        x += np.uint64(1)
        x *= p[: len(x)]
        np.cumsum(x, out=x)
        return mix((total[self.end] - total[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64) * _R)

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), off


def slices(column: pa.Array, breaks: np.ndarray = SPACES, size: int = SLICE) -> Iterator[Slice]:
    """The column's texts in slices of ``size`` bytes; ``breaks`` marks the bytes that separate words."""
    raw, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        data, at = LOWER[raw[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
        solid = ~breaks[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Slice(lo, hi, data, at, start, end, np.searchsorted(start, at))
        lo = hi
