"""Vectorised word splitting and Rabin-Karp hashing over Arrow string columns.

Every function works on one slice of documents whose bytes lie one after
another in a buffer. A word's hash takes its bytes eight at a time through a
mixing function (equal lengths up to eight bytes: no two words share one);
words of more than ``LONG`` bytes take BLAKE2. Window hashes come from prefix
sums of ``hash * BASE**i`` modulo 2**64, so one pass over the words serves
every window, whatever its length. The polynomial is over well-mixed values
and meant for windows of some dozens of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
#: Bytes from which a word is hashed apart from the others.
LONG = 256
_SEED, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

#: Bytes of words that stand between white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, lower-case letters and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 1 << int(n + 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base & (2**64 - 1), dtype=U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_word_powers = _Powers(_WORD_BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of windows, and of its inverse, at least up to n."""
    return _word_powers.upto(n)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    h = mix(length.astype(U64) * _STEP + _SEED)
    live = np.flatnonzero(length <= LONG)
    k = 0
    while len(live):
        left = length[live] - k
        h[live] = mix(h[live] ^ (eight[start[live] + k] & _MASKS[np.minimum(left, 8)]))
        live = live[left > 8]
        k += 8
    for i in np.flatnonzero(length > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """Words of a slice of documents; word i of document d is ``first[d] + i``."""

    data: np.ndarray  # bytes, lower-cased where asked for
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # number of the first word of each document, and the total
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def as_strings(column) -> pa.Array:
    """A large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array, and each string's offsets in them."""
    _, offsets, data = strings.buffers()
    if len(strings) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(strings) + 1, strings.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(strings: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs that hold at most ``most`` bytes or a single row."""
    _, at = bytes_of(strings)
    lo, n = 0, len(strings)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, strings.slice(lo, hi - lo)
        lo = hi


def split(strings: pa.Array, table: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words are the longest runs of bytes that ``table`` marks, after lower-casing A-Z if ``lower``."""
    data, at = bytes_of(strings)
    if lower:
        data = LOWER[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(at), np.int64), np.zeros(0, U64))
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, at), word_hashes(data, start, end))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which a window of n words of one document starts, and the windows' hashes."""
    total = len(w.hash)
    last = np.repeat(w.first[1:], np.diff(w.first)) - n
    at = np.flatnonzero(np.arange(total) <= last)
    return at, span_hash(w, at, np.full(len(at), n, np.int64))


def span_hash(w: Words, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the ``length`` words from each word ``at``; equal word sequences have equal hashes."""
    total = len(w.hash)
    up, down = _word_powers.upto(total)
    sums = np.empty(total + 1, U64)
    sums[0] = 0
    np.cumsum(w.hash * up[:total], out=sums[1:])
    return mix((sums[at + length] - sums[at]) * down[at] + length.astype(U64) * U64(0x9FB21C651E98DF25))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(np.asarray(start, np.int64) - before, length) + np.arange(total)
