"""Array primitives on UTF-8 text: chunks of an Arrow column, words, hashes of any substring.

Texts are handled as one byte buffer with offsets, so that the work is numpy's and no
Python object is made for a word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: bytes 0x09-0x0D and 0x20 part words
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RNG = np.random.default_rng(20240229)
_TABLES = [_RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95 | 5]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the usual xor-shift-multiply finaliser)."""
    h = h ^ U64(seed)
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _powers(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        base, inverse = _BASES[kind], pow(_BASES[kind], -1, 1 << 64)
        have = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, dtype=U64))]) for b in (base, inverse))
        if size <= 1 << 22:
            _POWERS[kind] = have
    return have


class SubstringHash:
    """64-bit hash of any [start, end) of a buffer in constant time, equal for equal bytes."""

    def __init__(self, buf: np.ndarray, kind: int = 0):
        n = len(buf)
        up, self.down = _powers(kind, n + 1)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_TABLES[kind][buf] * up[:n], out=self.sums[1:])
        self.kind = kind

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(U64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * U64(0x2545F4914F6CDD1D), 0x5851F42D4C957F2D + self.kind)


def windows(h: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """Order-sensitive hash of every `size` consecutive values (len(h) - size + 1 of them)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(size):
        out *= U64(_BASES[1 - kind])
        out += h[j : j + n]
    return mix(out, size + 977 * kind)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large_binary without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of no chunk
        column = pa.array([], column.type)
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column from as_bytes; offsets start at 0."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `target` bytes: (first row, end row, bytes, offsets).

    A text longer than the target is a run of its own; nothing is cut.
    """
    buf, offs = buffer_of(as_bytes(column))
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(buf: np.ndarray, offs: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which `apart` (a table by byte) is false: starts, ends, row of each.

    A run never crosses a row.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = apart[buf]
    before = np.empty(len(buf), dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    edge = offs[:-1]
    before[edge[edge < len(buf)]] = True
    after = np.empty(len(buf), dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:]
    edge = offs[1:]
    after[edge[edge > 0] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def first_of_rows(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) into a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Boolean array of n: what lies in [s, s + size) of any start."""
    mark = np.zeros(n + 1, dtype=np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + size, n), -1)
    return np.cumsum(mark[:-1]) > 0


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside those of later ones."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
