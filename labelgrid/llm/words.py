"""Words of Arrow text columns as numpy arrays: no Python object per word.

A column is taken as one byte buffer with row offsets. Hashes of words and of runs of words come from prefix sums of
``value * base**-i`` modulo 2**64 (the base is odd, hence invertible), so the hash of any run is one subtraction and one product.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all others."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 23:  # a single huge text is not kept in mind
            _powers[base] = have
    return have


class Runs:
    """Hashes of runs ``[start, end)`` of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        self.up, down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * down[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each row starts and ends. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back: a Python worker that waits for its next task would keep the size of its last one."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def pieces(batches, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches with at most about ``most`` bytes of text each; a longer single row stays whole. Memory is given back after each."""
    for batch in batches:
        sizes = np.diff(flat(batch.column(column))[1])
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
            yield batch.slice(at, n)
            at += n
            release()


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word (rows + 1 entries)."""
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    after = np.ones(len(data), bool)  # the byte before is a space or belongs to another row
    after[1:] = ~inside[:-1]
    after |= first[:-1]
    starts = np.flatnonzero(inside & after)
    before = np.ones(len(data), bool)
    before[:-1] = ~inside[1:]
    before |= first[1:]
    ends = np.flatnonzero(inside & before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


BLOCK = 1 << 19


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, computed over blocks of bytes so that a very long text needs no more memory than a short one."""
    values = BYTE_VALUES[LOWER] if lower else BYTE_VALUES
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low = starts[at]
        runs = Runs(values[data[low : ends[stop - 1]]])
        out[at:stop] = runs.of(starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return out


def windows(firsts: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a run of ``size`` words starts that ends in the same row."""
    total = int(firsts[-1])
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(total)
    return np.flatnonzero(left >= size)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
