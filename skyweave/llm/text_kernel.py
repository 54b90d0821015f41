"""Vectorised text primitives for Arrow batches: words, word hashes, distinct shingles.

Everything works on the UTF-8 buffer of a batch at once.  Texts are taken in
runs of bounded bytes (``byte_runs``), so temporaries stay small however large
an Arrow batch is.  Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK = (1 << 64) - 1
#: Bytes of text taken at once; a single longer text is taken whole.
RUN_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit number for each byte value.
_BYTE = np.random.default_rng(20260101).integers(1, MASK, 256, dtype=U64, endpoint=True)


@contextlib.contextmanager
def tidy():
    """Around a task's work: gives free memory back, as workers stay for a while after a task."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries trim by themselves
            ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.empty(n, U64), np.empty(n, U64)
    up[0] = down[0] = 1
    up[1:], down[1:] = U64(_BASE), U64(_INVERSE)
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a common hash, so that all bits depend on all."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets starting at 0."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, (at - at[0]) if len(column) else np.zeros(1, np.int64)


def byte_runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = stop


def spans(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words never cross rows."""
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """For each array of ends, a 64-bit hash of every span of bytes, from prefix sums of a polynomial."""
    up, down = _powers(max(20, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    before, factor = total[start], down[start]
    return [mix((total[end] - before) * factor + (end - start).astype(U64)) for end in ends]


def shingles(words: np.ndarray, row: np.ndarray, rows: int, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; rows of fewer words have the whole sequence as one."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    factor = [U64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(size)]
    n = len(words) - size + 1
    if n > 0:
        every = words[:n] * factor[0]
        for k in range(1, size):
            every = every + words[k : k + n] * factor[k]
        every = mix(every)
    out = []
    for r in range(rows):
        a, c = int(first[r]), int(count[r])
        if c >= size:
            out.append(np.unique(every[a : a + c - size + 1]))
        elif c:
            value = int(c)
            for w in words[a : a + c].tolist():
                value = (value * 0xD6E8FEB86659FD93 + w) & MASK
            out.append(mix(np.array([value ^ 0x5851F42D4C957F2D], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text in turn the sorted hashes of its distinct lower-cased shingles."""
    raw, offsets = texts_of(column)
    for a, b in byte_runs(offsets):
        part = LOWER[raw[offsets[a] : offsets[b]]]
        start, end, row = spans(part, at := offsets[a : b + 1] - offsets[a])
        yield from shingles(span_hashes(part, start, end)[0], row, len(at) - 1, size)
