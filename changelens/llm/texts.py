"""Byte-level text helpers: whole Arrow batches of UTF-8 text are cut into words and hashed with numpy.

A *word* is a maximal run of bytes other than space and 0x09-0x0D, which on UTF-8 is the same as the
pattern ``[^\\x20\\x09-\\x0D]+`` on code points. Work arrays hold a few megabytes whatever the text length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at once, and bytes of text taken together from a batch.
HASH_BYTES = 1 << 20
SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER_A_Z = np.zeros(256, bool)
LETTER_A_Z[[*range(65, 91), *range(97, 123)]] = True
#: Not a continuation byte: one such byte for each code point.
LEAD = (np.arange(256) & 0xC0) != 0x80


def give_back() -> None:
    """Return freed memory to the system: workers live on, and other tasks need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def then_give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` over the batches of a partition; afterwards what it has freed is given back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def group_then_give_back(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` of a group; afterwards what it has freed is given back."""

    def whole(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return whole


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the ``len + 1`` bounds of the texts; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return text, bounds.astype(np.int64) - int(bounds[0])


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, each of one row at least."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, end
        row = end


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) for row ranges of about ``limit`` bytes."""
    text, bounds = utf8(column)
    for row, end in slices(bounds, limit):
        yield row, end, text[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a bound."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def of_rows(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``len(bounds)`` bounds of the rows in an array whose elements begin at byte ``starts``."""
    return np.searchsorted(starts, bounds, "left")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public finaliser of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of an odd base and of its inverse modulo 2**64."""
    values = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    base = 0xD1342543DE82EF95
    powers = lambda b, n: np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)]))
    return values, powers(base, HASH_BYTES), powers(pow(base, -1, 1 << 64), HASH_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, up, down = _tables()
    if n <= HASH_BYTES:
        return up, down
    more = lambda p: np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, p[1], U64)]))
    return more(up), more(down)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order of their starts and do not overlap."""
    out = np.empty(len(starts), U64)
    values = _tables()[0]
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        high = int(ends[last - 1])
        up, down = _powers(high - low)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(values[text[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mixed((sums[b] - sums[a]) * down[np.minimum(a, high - low - 1)] + (b - a).astype(U64))
        first = last
    return out


class Substrings:
    """Hashes of any substrings of some bytes, from one pass of sums."""

    def __init__(self, text: np.ndarray) -> None:
        up, self.down = _powers(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, U64)
        np.cumsum(_tables()[0][text] * up[: len(text)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] + lengths.astype(U64))


#: Odd factors of the words of a window, first to last.
_PLACES = mixed(np.arange(1, 65, dtype=U64)) | U64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` successive word hashes."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, size, U64)
    for place in range(size):
        total += words[place : place + n] * _PLACES[place]
    return mixed(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_of_rows(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (bool or small int) between successive bounds."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
