"""Vectorised word hashing over Arrow string arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the same as the
code-point class [^\\x20\\x09-\\x0D]+ since these bytes never occur inside a multi-byte UTF-8
sequence. A-Z may be lower-cased first. Hashes are 64 bits: the sum of a random value per byte
times a power of an odd base, divided by the power at the word's start, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20  # bytes hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.Generator(np.random.Philox(20260101)).integers(1, 2**63, 256, dtype=np.int64).astype(U)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _pow:
        if size > BLOCK * 2:  # a single word of this size; not kept
            return tuple(np.multiply.accumulate(np.r_[U(1), np.full(n, b, U)]) for b in (U(_BASE), U(pow(_BASE, -1, 2**64))))
        _pow.clear()
        _pow[size] = tuple(np.multiply.accumulate(np.r_[U(1), np.full(size, b, U)]) for b in (U(_BASE), U(pow(_BASE, -1, 2**64))))
    return _pow[size]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(off):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SEP[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word."""
    out = np.empty(len(starts), U)
    values = _LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        s0 = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, s0 + BLOCK, "right")))
        n = int(ends[j - 1] - s0)
        up, down = _powers(n)
        total = np.zeros(n + 1, U)
        np.cumsum(values[data[s0 : s0 + n]] * up[:n], out=total[1:])
        s, e = starts[i:j] - s0, ends[i:j] - s0
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and the n + 1 offsets of the rows in them."""
    data, off = raw(texts)
    starts, ends, at = spans(data, off)
    return hashes(data, starts, ends, lower), at


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK):
    """The batch in runs of rows with about `most` bytes of text each; a longer row comes alone."""
    col = batch.column(column) if batch.num_rows else None
    if col is None:
        return
    _, off = raw(col)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def parts(texts: pa.Array, most: int = BLOCK):
    """Like slices(), for a bare array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, off = raw(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, a function from batches to batches, that gives its memory back to the system when a task ends: idle Python workers stay for a while."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            _pow.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim:
                trim(0)

    return run
