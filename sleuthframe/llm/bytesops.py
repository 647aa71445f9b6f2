"""Vectorised byte kernels shared by the operators that run on Arrow batches.

A batch's text column is one contiguous UTF-8 buffer with offsets, so words, lines and
windows of many documents are found and hashed with a few NumPy passes and no per-word
Python.  Hashes are polynomial over Z/2^64 with a random 64-bit value for each byte and a
strong final mix; they depend on content only, so they agree between executors.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes worked on at once: eight-byte arrays of this length still fit a core's cache.
CHUNK_BYTES = 1 << 19


def release() -> None:
    """Give memory that a task has freed back to the system: its worker stays on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public SplitMix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z when ``lower``."""
    table = mix((np.arange(256, dtype=U) + U(1)) * U(BASE) + U(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a task, whose worker gives its memory back when the task is done."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


EXACT = byte_table(11)
LOWER = byte_table(11, lower=True)

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 19, min(2 * len(_powers), 1 << 24))
        one, two = np.full(size, U(BASE)), np.full(size, U(_INVERSE))
        one[0] = two[0] = 1
        _powers, _inverses = np.cumprod(one, dtype=U), np.cumprod(two, dtype=U)
    return _powers[:n], _inverses[:n]


def prefix_hash(data: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal content has equal hashes wherever it stands."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole texts of about ``size`` bytes."""
    data, off = text_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _edges(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that don't cross texts: starts, ends, and each text's first run."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first, last = off[:-1], off[1:] - 1
    before[first[first < n]] = False
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: starts, ends, and the index of each text's first word."""
    return _edges(_IS_WORD[data], off)


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty \\n-split lines of each text, as ``words``."""
    return _edges(data != 10, off)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values from each position (those over a text's end are for the caller to leave out)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = mix(hashes[:m] + U(n))
    for k in range(1, n):
        out = mix(out * U(BASE) + hashes[k : k + m])
    return out


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a short sequence, apart from those of ``grams`` of other lengths."""
    return grams(hashes, len(hashes))[0]


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct word shingles (A-Z lower-cased); fewer words than ``size``: the whole sequence as one; no words: empty."""
    starts, ends, first = words(data, off)
    hashed = span_hash(prefix_hash(data, LOWER), starts, ends)
    every, out = grams(hashed, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(np.array([whole(hashed[a:b])], U) if b > a else np.zeros(0, U))
    return out
