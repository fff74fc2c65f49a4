"""Vectorised word and shingle hashing over Arrow text batches.

A word is a match of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a null text
is an empty one.  Work is done in slices of about ``SLICE_BYTES`` of text, a
single longer text being one slice, so memory follows the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())  # gives freed buffers back; workers live through all stages of a job
SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


@lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library keeps its own books
        return lambda _: 0


def trim() -> None:
    """Give the memory that earlier batches freed back to the system; workers live through all stages of a job."""
    _malloc_trim()(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    trim()
    col = column.cast(pa.large_string()).fill_null("")
    n, first = len(col), col.offset
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + first + 1)[first:]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n+1 word offsets of the rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes a step."""
    padded = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(padded) - 7,), strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * _M3
    h = mix(h ^ (eight[starts] & _MASKS[np.minimum(left, 8)]))
    live = np.flatnonzero(left > 8)
    step = 8
    while len(live):
        rest = left[live] - step
        h[live] = mix(h[live] * _M1 ^ (eight[starts[live] + step] & _MASKS[np.minimum(rest, 8)]))
        step += 8
        live = live[rest > 8]
    return h


def row_ids(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def shingles(hashes: np.ndarray, word_offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words that lies in one row, in order, and the n+1 shingle offsets.

    A row with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words = np.diff(word_offsets)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    rows = row_ids(count)
    first = word_offsets[rows] + (np.arange(offsets[-1]) - offsets[rows])
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    length = np.minimum(words[rows], size)
    acc = length.astype(np.uint64) * _M3
    for j in range(size):
        acc = np.where(j < length, (acc ^ (acc >> np.uint64(31))) * _M1 + padded[first + j], acc)
    return mix(acc), offsets


def shingle_rows(column: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, its shingles in order, its word count) of a text column."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, w = word_spans(part, off)
        sh, so = shingles(word_hashes(part, s, e), w, size)
        for r in range(b - a):
            yield a + r, sh[so[r] : so[r + 1]], int(w[r + 1] - w[r])
