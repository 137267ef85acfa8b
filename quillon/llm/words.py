"""Words, word hashes and shingle sets of whole Arrow batches, by array operations on their UTF-8 bytes.

A word is a run of bytes other than space and U+0009 to U+000D; both kinds are ASCII, so bytes and characters agree.
Hashes have 64 bits and depend on nothing but the word's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes hashed at a time.
_SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (a finaliser of two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(1 << (n - 1).bit_length() if n > 1 else 1, _ODD, np.uint64))
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the rows' offsets in them; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    width = 8 if pa.types.is_large_string(column.type) else 4
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], f"i{width}", len(column) + 1, column.offset * width).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(column: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """Slices of a text column of at most `most` bytes, or of one row."""
    size = np.diff(utf8(column)[1])
    ends = np.cumsum(size)
    at = 0
    while at < len(column):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = max(upto, at + 1)
        yield column.slice(at, upto - at)
        at = upto


class Words:
    """starts, ends: byte positions of all words; first: of each row its first word, with the number of words at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        at = offsets[(offsets > 0) & (offsets < len(data))]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[at] = inside[at]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        stops[at - 1] = inside[at - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):  # segments end between words
            upto = max(int(np.searchsorted(self.ends, self.starts[at] + _SEGMENT, "right")), at + 1)
            begin, end = self.starts[at], self.ends[upto - 1]
            own = self.starts[at:upto] - begin
            place = np.arange(end - begin) - np.repeat(own, np.diff(own, append=end - begin))
            table = _power_table(int(place.max()) + 1)
            value = (self.data[begin:end].astype(np.uint64) + np.uint64(1)) * table[place] * self.inside[begin:end]
            out[at:upto] = np.add.reduceat(value, own)
            at = upto
        return mix(out + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chained(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values; runs of different k never share a seed."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k * 0xA0761D6478BD642F % (1 << 64), np.uint64)
    for j in range(k):
        out = (out ^ values[j : j + n]) * np.uint64(0xE7037ED1A0B428DB)
        out = out ^ (out >> np.uint64(32))
    return mix(out)


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every row laid end to end, the rows' offsets in them, and the word hashes.

    A row of fewer than k words, but not none, has its whole sequence as one shingle.
    """
    hashes = words.hashes()
    first, count = words.first[:-1], np.diff(words.first)
    runs = chained(hashes, k)
    row = np.repeat(np.arange(len(count)), np.maximum(count - k + 1, 0))
    at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(count - k + 1, 0)) - np.maximum(count - k + 1, 0), np.maximum(count - k + 1, 0))
    value = runs[first[row] + at] if len(row) else np.zeros(0, np.uint64)
    for short in range(1, k):
        own = np.flatnonzero(count == short)
        if len(own):
            row = np.concatenate([row, own])
            value = np.concatenate([value, chained(hashes, short)[first[own]]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[fresh], value[fresh]
    return value, np.searchsorted(row, np.arange(len(count) + 1)), hashes
