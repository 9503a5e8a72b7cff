"""Words drawn from whole texts, a batch of texts at a time.

A batch is folded and cut into words by passes over its bytes, and the words
are numbered; what is done for each word of a text is arithmetic on numbers,
and only the distinct words of the batch are hashed, thousands at once.
"""

from __future__ import annotations

from hashlib import md5
from math import sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import tables as t
from kinfold.functions.normalize import ACCENTED, BASE

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] += 32
#: Bytes that stand for a character outside words, and for nothing.
_OUTSIDE, _GONE = 0x80, 0xFF
#: Bytes of texts that are folded and cut at once.
_PART = 1 << 19


def _letters(c: str) -> list[int]:
    """What ``normalize.fold`` makes of a character, as bytes of words or ``_OUTSIDE``."""
    low = c.lower().translate(str.maketrans(ACCENTED, BASE))
    for ligature, letters in t.LIGATURES:
        low = low.replace(ligature, letters)
    return [ord(x) if x.isascii() and x.isalnum() else _OUTSIDE for x in low]


#: Of each character of two bytes, both bytes after folding: none becomes longer.
_PAIRS = np.full((0x250, 2), _OUTSIDE, np.uint8)
for _code in range(0xC0, 0x250):
    _PAIRS[_code] = ([*_letters(chr(_code)), _GONE])[:2]
#: Longer characters whose lower case is one of these: Kelvin, Angstrom, capital sharp s.
_LONGER = tuple((c.encode(), _letters(c)) for c in "\u212a\u212b\u1e9e")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    _, offsets, held = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(held, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8), at - at[0]


def folded(texts: pa.Array) -> pa.Array:
    """``normalize.fold`` of a batch, as far as words ``[a-z0-9]+`` go: other characters are left as bytes outside words."""
    data, at = _bytes(pc.fill_null(texts.cast(pa.large_binary()), b""))
    out = _LOWER[data]
    if len(data) and data.max() >= 0x80:
        last = np.zeros(len(data) + 1, bool)
        last[at] = True  # a character doesn't go on in the next text
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9) & (data[1:] & 0xC0 == 0x80) & ~last[1:-1])
        pairs = _PAIRS[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
        out[lead], out[lead + 1] = pairs[:, 0], pairs[:, 1]
        gone = np.zeros(len(data), bool)
        gone[lead + 1] = pairs[:, 1] == _GONE
        for (a, b, c), letters in _LONGER:
            i = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c) & ~last[1:-2] & ~last[2:-1])
            for k, letter in enumerate([*letters, _GONE, _GONE][:3]):
                out[i + k], gone[i + k] = letter, letter == _GONE
        at = at - np.concatenate([[0], np.cumsum(gone)])[at]
        out = out[~gone]
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words ``[a-z0-9]+`` of each text, and the words of all."""
    data, at = _bytes(pc.fill_null(texts.cast(pa.large_binary()), b""))
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = at[:-1][at[:-1] < at[1:]]
    first[starts] = inside[starts]  # no word goes on in the next text
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])])
    return np.diff(np.searchsorted(begin, at)), words


def _place(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _by_length(names: pa.Array) -> np.ndarray:
    """The words from long to short, equally long ones by name. The key is 99,999 less the length, as five characters."""
    lengths, which = np.unique(pc.binary_length(names).to_numpy(), return_inverse=True)
    keys = [str(99_999 - n)[:5].rjust(5, "0") for n in lengths.tolist()]
    number = {k: i for i, k in enumerate(sorted(set(keys)))}  # very long words can have one key
    return np.lexsort((_place(pc.sort_indices(names).to_numpy()), np.array([number[k] for k in keys], np.int64)[which]))


#: The constants and shifts of MD5, and words hashed at once.
_SINES = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_AT_ONCE = 8192


def _md5(words: pa.Array) -> np.ndarray:
    """The MD5 of words of at most 55 bytes, as rows of two big-endian numbers: the one block of each, all words side by side."""
    data, at = _bytes(words)
    lengths = np.diff(at)
    block = np.zeros((len(words), 64), np.uint8)
    block[np.arange(64) < lengths[:, None]] = data
    block[np.arange(len(words)), lengths] = 0x80
    block[:, 56:] = (lengths * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
    m = block.view("<u4").T.astype(np.uint32, order="C")
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(words), x) for x in first)
    for i, (sine, turn) in enumerate(zip(_SINES, _TURNS)):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += sine
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    state = np.stack([x + y for x, y in zip((a, b, c, d), first)], axis=1)
    return state.astype("<u4").view(">u8").astype(np.uint64)


def _digests(names: pa.Array) -> np.ndarray:
    """The MD5 of every word, as two numbers."""
    out = np.empty((len(names), 2), np.uint64)
    lengths = pc.binary_length(names).to_numpy()
    short, long = np.flatnonzero(lengths <= 55), np.flatnonzero(lengths > 55)
    for i in range(0, len(short), _AT_ONCE):
        some = short[i : i + _AT_ONCE]
        out[some] = _md5(names.take(pa.array(some)))
    if len(long):
        out[long] = np.frombuffer(b"".join(md5(w).digest() for w in names.take(pa.array(long)).to_pylist()), ">u8").reshape(-1, 2)
    return out


def _by_digest(names: pa.Array) -> np.ndarray:
    """The words in the order of their MD5."""
    digests = _digests(names)
    order = np.argsort(digests[:, 0])
    first = digests[order, 0]
    return order if (first[1:] > first[:-1]).all() else np.lexsort((digests[:, 1], digests[:, 0]))


def _parts(texts: pa.Array) -> list[pa.Array]:
    """Slices of about ``_PART`` bytes, so that what is made of one stays in the cache."""
    _, at = _bytes(texts)
    cuts = np.unique(np.append(np.searchsorted(at, np.arange(0, at[-1], _PART)), len(texts)))
    return [texts.slice(lo, hi - lo) for lo, hi in zip([0, *cuts[cuts > 0].tolist()], cuts[cuts > 0].tolist())]


def draw(texts: pa.Array, longest: int, dealt: int, fold: bool = False) -> pa.Array:
    """``drawn_words`` of a batch, folded before or, with ``fold``, here."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    found = [cut(folded(part) if fold else part) for part in _parts(texts)]
    counts = np.concatenate([np.empty(0, np.int64), *(c for c, _ in found)])
    coded = pa.concat_arrays([pa.array([], pa.large_binary()), *(w for _, w in found)]).dictionary_encode()
    names, bits = coded.dictionary, len(coded.dictionary).bit_length()
    orders = [order(names) for order in (_by_digest, _by_length)] if len(names) else [np.empty(0, np.int64)] * 2
    text, word = np.repeat(np.arange(n, dtype=np.int64), counts), coded.indices.to_numpy(zero_copy_only=False)
    out = []
    for order, most in zip(orders, (dealt, longest)):
        keyed = text << bits
        keyed |= _place(order)[word]
        keyed.sort()
        if not out:
            keyed = keyed[np.diff(keyed, prepend=-1) > 0]
        text, word = keyed >> bits, order[keyed & (1 << bits) - 1]  # the distinct words of each text
        at = np.searchsorted(keyed, np.arange(n + 1) << bits)
        kept = np.arange(len(keyed)) - at[text] < most
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(text[kept], minlength=n))]).astype(np.int64), names.take(pa.array(word[kept])).cast(pa.string()))
        out.append(pc.binary_join(lists, " "))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), out[1].cast(pa.string()), out[0].cast(pa.string())], ["words", "longest", "dealt"])


def drawn_words(text: Column, longest: int, dealt: int) -> Column:
    """A struct of a text, folded: its number of words ``[a-z0-9]+``, the ``longest`` longest distinct ones and the ``dealt`` ones whose MD5 comes first, joined by blanks."""

    @F.arrow_udf("words int, longest string, dealt string")
    def run(texts: pa.Array) -> pa.Array:
        return draw(texts, longest, dealt, fold=True)

    return run(text)
