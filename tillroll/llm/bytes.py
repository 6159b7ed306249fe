"""Texts of an Arrow batch as UTF-8 bytes, and hashes over them without a loop per word.

Memory: a chunk holds about CHUNK bytes of texts, or one text where that is longer; the arrays
over a chunk take about a hundred times its size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: The blanks between words: space and 0x09-0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Give memory that is free again back to the system: workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back is not None:
        give_back(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def xxhash64(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a column of longs."""

    def rotl(v: np.ndarray, n: int) -> np.ndarray:
        return (v << np.uint64(n)) | (v >> np.uint64(64 - n))

    h = np.full(len(x), np.uint64(42 + 8) + _P5)
    h ^= rotl(x.view(np.uint64) * _P2, 31) * _P1
    h = rotl(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(offsets: np.ndarray, size: int = CHUNK, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes each, and at most `most_rows` rows."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), first + most_rows, n)
        yield first, last
        first = last


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, back)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run [start, end)."""
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def padded(data: np.ndarray, offsets: np.ndarray, pad: int, byte: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with `pad` bytes before, between and after them; starts and ends of the rows."""
    lengths = np.diff(offsets)
    starts = pad + np.concatenate(([0], np.cumsum(lengths + pad)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    out = np.full(int(lengths.sum()) + pad * (len(lengths) + 1), byte, np.uint8)
    if lengths.sum():
        row = np.repeat(starts - (offsets[:-1] - offsets[0]), lengths)
        out[np.arange(len(row)) + row] = data[offsets[0] : offsets[-1]]
    return out, starts, starts + lengths
