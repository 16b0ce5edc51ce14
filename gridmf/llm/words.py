"""Whole-batch word arithmetic on UTF-8 bytes, shared by the text operators.

Texts stay in Arrow's byte buffers: words, their 64-bit hashes and their positions come
from a handful of numpy passes over slices of a few MB, never from a loop over words.
A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D`` after lower-casing A-Z; a null
text counts as empty.  Word hashes are 64 bits of a keyed polynomial over table-scrambled
bytes, finished by splitmix64: two different words share one with odds of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_ODD) + U64((seed * 0xD1342543DE82EF95) % 2**64))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = seeds(256, 11)
_P = 0x2545F4914F6CDD1D
_IP = pow(_P, -1, 2**64)


_held: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers and inverse powers; the longest made so far are kept."""
    if not _held or len(_held[0][0]) < n + 1:
        size = 1 << 16
        while size < n + 1:
            size *= 2
        a, b = np.full(size, _P, U64), np.full(size, _IP, U64)
        a[0] = b[0] = 1
        _held[:] = [(np.cumprod(a, dtype=U64), np.cumprod(b, dtype=U64))]
    return _held[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; a longer text comes alone."""
    if len(column) == 0:
        return
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True bytes that no text boundary crosses, and each text's first run."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    pw, ipw = powers(len(buf))
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * pw[:len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * ipw[starts] + (ends - starts).astype(U64) * U64(_ODD))


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE):
    """(word hashes, starts, ends, each text's first word) of lower-cased bytes."""
    low = LOWER[buf]
    starts, ends, first = runs(~space[buf], offs)
    return hash_runs(low, starts, ends), starts, ends, first


def hash_word(word: str | bytes) -> int:
    """The hash ``words`` gives a single word (lower-case it first)."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(hash_runs(LOWER[raw], np.array([0]), np.array([len(raw)]))[0])


def shingles(h: np.ndarray, first: np.ndarray, size: int):
    """(shingle hashes, each text's first shingle): windows of ``size`` words; a shorter text is one sequence."""
    counts = np.diff(first)
    n_out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(n_out, out=at[1:])
    out = np.zeros(at[-1], U64)
    if len(out) == 0:
        return out, at
    mult = seeds(size, 23) | U64(1)
    n_win = max(len(h) - size + 1, 0)
    win = np.zeros(n_win, U64)
    for k in range(size):
        win += h[k:k + n_win] * mult[k]
    doc = np.repeat(np.arange(len(counts)), n_out)
    pos = first[doc] + np.arange(len(out)) - at[doc]
    full = counts[doc] >= size
    out[full] = win[pos[full]]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        part = h[first[d]:first[d + 1]]
        out[at[d]] = (part * mult[:len(part)]).sum(dtype=U64) + U64(len(part))
    return mix(out), at


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 where absent."""
    if len(table) == 0 or len(keys) == 0:
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Table:
    """Sorted 64-bit keys with a bit filter in front: most absent keys cost one lookup."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(np.asarray(keys, U64))
        bits = 16
        while (1 << bits) < 16 * len(self.keys) and bits < 24:
            bits += 1
        self.shift = U64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``keys`` that are in the table, their index in it)."""
        near = np.flatnonzero(self.seen[(keys >> self.shift).astype(np.int64)])
        at = find(self.keys, keys[near])
        hit = at >= 0
        return near[hit], at[hit]
