"""Words of Arrow string columns as numpy arrays, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word: tab to carriage return, and space.
SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Free memory of a worker back to the system, at the end of its task; the worker lives on, and others share the executor's limit with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column without nulls, about ``limit`` bytes at a time.

    Yields (first row, end row, their UTF-8 bytes, offsets of rows in them).  A row
    longer than the limit comes alone.
    """
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, cuts: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; no word goes over one of the positions ``cuts``."""
    word = ~gap[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inside = cuts[(cuts > 0) & (cuts < len(data))]
    first[inside] = word[inside]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inside - 1] = word[inside - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, by differences of one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    up, down = powers(len(data))
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_held = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier, and of its inverse modulo 2^64, for positions up to ``n``; kept for the next call unless very long."""
    global _held
    if len(_held[0]) > n:
        return _held
    size = max(n + 1, CHUNK_BYTES + CHUNK_BYTES // 4)
    made = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b))])) for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))
    if size <= 4 * CHUNK_BYTES:
        _held = made
    return made
