"""Words and their hashes for a whole Arrow batch at once, straight from the text buffers.

A word is a run of bytes other than space, tab, LF, VT, FF and CR. Hashes are polynomial in 64-bit
arithmetic over random byte values, then mixed; two different ``seed`` values give independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are held as 64-bit numbers at once; a longer text makes a chunk of its own.
CHUNK = 600_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def byte_values(seed: int, fold: bool = False) -> np.ndarray:
    """A random number for each byte; with ``fold``, capital ASCII letters share those of the small ones."""
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64; kept, and grown when needed."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)

        def series(factor: int) -> np.ndarray:
            out = np.full(size, factor, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        _POWERS[:] = series(BASE), series(pow(BASE, -1, 2**64))
    return _POWERS


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The hash of values[start:end] for each pair of bounds."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))


class Words:
    """The words of some texts: ``start`` and ``end`` byte bounds, ``doc`` row and ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = GAPS):
        self.data, self.offsets = data, offsets
        n = len(offsets) - 1
        inside = ~gaps[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = inside[heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 1, fold: bool = False) -> np.ndarray:
        return span_hashes(byte_values(seed, fold)[self.data], self.start, self.end, seed)

    def windows(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words that lie in one text."""
        if len(self) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self) - size + 1] == self.doc[size - 1 :])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings, nulls as empty texts."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, gaps: np.ndarray = GAPS) -> Iterator[tuple[int, int, Words]]:
    """Rows [first, last) of a column of strings with their words, about CHUNK bytes at a time; bytes of ``gaps`` end a
    word."""
    data, offsets = texts(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield first, last, Words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], gaps)
        first = last


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
