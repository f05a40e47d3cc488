"""Vectorised hashes of byte ranges, words and word shingles in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(fold: bool, seed: int) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
    if fold:
        values[65:91] = values[97:123]
    return values


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        out = []
        for b in (BASE, BASE_INVERSE):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS.clear()
        _POWERS[n] = (out[0], out[1])
    return _POWERS[n]


class Sums:
    """Hashes of any range of 64-bit values, by prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(18, int(len(values) + 1).bit_length())
        power, self._inverse = _powers(size)
        self._sums = np.empty(len(values) + 1, dtype=np.uint64)
        self._sums[0] = 0
        np.cumsum(values * power[: len(values)], out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._inverse[start]

    def fixed(self, width: int) -> np.ndarray:
        """Unmixed hash of each ``width`` values in a row."""
        n = len(self._sums) - width
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return (self._sums[width:] - self._sums[:n]) * self._inverse[:n]


class RangeHash(Sums):
    """Hashes of any byte range of ``data``."""

    def __init__(self, data: np.ndarray, fold: bool = False, seed: int = 1):
        super().__init__(_byte_values(fold, seed)[data])


@dataclass
class Texts:
    """The texts of some rows, one after the other: ``data[offsets[i]:offsets[i + 1]]``."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def of(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def texts(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Whole texts in chunks of bounded size; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + chunk_bytes, side="right")) - 1)
        last = min(last, n)
        yield Texts(slice(first, last), data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words (runs of bytes other than ASCII white space) with ASCII case folded."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: Place of the word in its text.
    place: np.ndarray


def words(t: Texts) -> Words:
    space = _SPACE[t.data]
    edge = np.zeros(len(t.data) + 1, dtype=bool)
    edge[t.offsets] = True
    before = np.ones(len(t.data), dtype=bool)
    before[1:] = space[:-1]
    after = np.ones(len(t.data), dtype=bool)
    after[:-1] = space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    text = t.of(start)
    place = np.arange(len(start)) - np.searchsorted(text, np.arange(len(t.offsets) - 1))[text]
    return Words(text, start, end, mix(RangeHash(t.data, fold=True).raw(start, end)), place)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each run of ``size`` words of one text."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(size):
            total += w.hash[j : j + n] * factor
            factor = factor * BASE
    at = np.flatnonzero(w.text[:n] == w.text[size - 1 :])
    return at, mix(total[at])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, y = 1, x
    while have * 2 <= width:
        y = np.minimum(y[:-have], y[have:])
        have *= 2
    return np.minimum(y[:n], y[width - have : width - have + n])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
