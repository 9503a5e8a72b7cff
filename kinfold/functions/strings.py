"""Edit-based string similarities, in Arrow batches.

``ratio`` is 200 * LCS / (len(a) + len(b)); the token variants compare sorted
tokens, and the token-set ratio takes the best of the common tokens and each
side's rest. Distinct pairs of a batch are compared once, all at a time: the
longest common subsequence and the Jaro similarity take a bit vector a pair, of
as many machine words as the string needs (one of more than 512 characters
takes a big integer, or is compared letter by letter).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Pairs = list[tuple[str, str]]
_WORD = 64
#: Words of a bit vector, at most; a longer string is one big integer.
_WORDS = 8
#: Words of bit vectors that are stepped together.
_CHUNK = 1 << 13
#: Strands that are combed together.
_STRANDS = 1 << 16


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as rows of numbers, padded by 0, and lengths."""
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(1, size.max(initial=0))), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def lcs_all(pairs: Pairs) -> np.ndarray:
    """Lengths of the longest common subsequences."""
    out = np.zeros(len(pairs), np.int64)
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    for chunk in _chunks([(-(-len(a) // _WORD), len(b)) for a, b in ordered], out, lambda i: lcs(*ordered[i])):
        out[chunk] = _lcs_words([ordered[i] for i in chunk])
    return out


def _chunks(sizes: list[tuple[int, int]], out: np.ndarray, alone: Callable[[int], float]):
    """Numbers of the pairs to step together, by words that one string takes and steps that the other takes; those of too many words get ``alone`` of their number, those of none nothing."""
    small: dict[int, list[int]] = {}
    for i, (words, _) in enumerate(sizes):
        if words > _WORDS:
            out[i] = alone(i)
        elif words:
            small.setdefault(words, []).append(i)
    for words, of in small.items():
        of.sort(key=lambda i: sizes[i][1])  # so that the pairs of a chunk take about as many steps
        many = max(1, _CHUNK // words)
        yield from (of[lo : lo + many] for lo in range(0, len(of), many))


def _places(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By word: bits of the places of each letter in ``a``, as rows of letters; where each step of ``b`` finds its letter's; lengths. A letter that no ``a`` has is found nowhere."""
    a, n = _codes(a)
    b, m = _codes(b)
    alphabet = np.array(sorted({0, *np.unique(a).tolist()}))
    number = np.zeros(max(int(a.max()), int(b.max())) + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    a, b = number[a], number[b]
    own = np.arange(len(a)) * len(alphabet)
    places = np.zeros((max(1, -(-a.shape[1] // _WORD)), len(a) * len(alphabet)), np.uint64)
    for i in range(a.shape[1]):
        here = np.flatnonzero(i < n)
        places[i // _WORD, own[here] + a[here, i]] |= np.uint64(1) << np.uint64(i % _WORD)
    return places, np.ascontiguousarray((b + own[:, None]).T), n, m


def _below(n: np.ndarray, word: int) -> np.ndarray:
    """The bits of a word for places less than ``n``."""
    k = np.clip(n - word * _WORD, 0, _WORD)
    return np.where(k == 0, np.uint64(0), ~np.uint64(0) >> (_WORD - np.maximum(k, 1)).astype(np.uint64))


def _lcs_words(pairs: Pairs) -> np.ndarray:
    """``lcs_all`` of pairs whose first strings take equally many words, one bit a character."""
    places, steps, n, _ = _places([x for x, _ in pairs], [y for _, y in pairs])
    left = np.full((len(places), len(pairs)), ~np.uint64(0))
    for at in steps:
        carry = None
        for w, own in enumerate(left):
            held = own & places[w].take(at)  # nothing beyond a string's end, where the letter is none
            total = own + held
            over = total < own
            if carry is not None:
                total += carry
                over |= total < carry
            left[w] = total | (own - held)
            carry = over.astype(np.uint64) if w + 1 < len(left) else None
    return n - sum(np.bitwise_count(own & _below(n, w)).astype(np.int64) for w, own in enumerate(left))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = x & y
    if common and (x <= y or y <= x):
        return 100.0
    base = " ".join(sorted(common))
    left = " ".join([*([base] if base else []), *sorted(x - y)])
    right = " ".join([*([base] if base else []), *sorted(y - x)])
    best = ratio(left, right)
    if base:
        best = max(best, ratio(base, left), ratio(base, right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against windows of the longer, windows over its ends included."""
    return float(partial_all([(a, b)])[0])


def ratio_all(pairs: Pairs) -> np.ndarray:
    size = np.array([len(a) + len(b) for a, b in pairs])
    return np.where(size > 0, 200.0 * lcs_all(pairs) / np.maximum(size, 1), 100.0)


def sort_all(pairs: Pairs) -> np.ndarray:
    return ratio_all([(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs])


def set_all(pairs: Pairs) -> np.ndarray:
    """``token_set_ratio`` of all pairs: up to three ratios each."""
    out, asked, of = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        common = x & y
        if not x or not y:
            continue
        if common and (x <= y or y <= x):
            out[i] = 100.0
            continue
        base = " ".join(sorted(common))
        left, right = (" ".join([*([base] if base else []), *sorted(z - common)]) for z in (x, y))
        three = [(left, right), *([(base, left), (base, right)] if base else [])]
        asked += three
        of += [i] * len(three)
    if asked:
        np.maximum.at(out, of, ratio_all(asked))
    return out


def partial_all(pairs: Pairs) -> np.ndarray:
    """``partial_ratio`` of all pairs."""
    out, rest = np.zeros(len(pairs)), []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if not a or a in b:
            out[i] = 100.0 if a or not b else 0.0
        else:
            rest.append((len(a) // 8, len(b), i, a, b))
    rest.sort()  # so that the pairs of a chunk are about as long
    lo = 0
    while lo < len(rest):
        hi = lo + max(1, _STRANDS // rest[lo][1])
        out[[r[2] for r in rest[lo:hi]]] = _windows([r[3] for r in rest[lo:hi]], [r[4] for r in rest[lo:hi]])
        lo = hi
    return out


def _combed(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Semi-local comparison by seaweeds: for every column of ``b``, by pair, which strand ends there; lengths; the first column's strand.

    Strands enter at the rows of ``a``, from the last, and then at the columns
    of ``b``. Two that meet cross, but not again and not where the letters are
    equal. Cells of a diagonal don't depend on each other, so a diagonal of all
    pairs is a step; rows and columns beyond a string's end change no other.
    """
    (x, n), (y, m) = _codes(a), _codes(b)
    letters = np.unique(np.concatenate([x.ravel(), y.ravel()]))
    kind = np.min_scalar_type(len(letters) + 1)
    x, y = ((np.searchsorted(letters, z) + 1).astype(kind) for z in (x, y))
    x[np.arange(x.shape[1]) >= n[:, None]] = 0
    y[np.arange(y.shape[1]) >= m[:, None]] = len(letters) + 1
    x, y = np.ascontiguousarray(x.T[::-1]), np.ascontiguousarray(y.T)
    rows, columns = len(x), len(y)
    kind = np.min_scalar_type(rows + columns)
    h = np.repeat(np.arange(rows, dtype=kind)[:, None], len(a), 1)
    v = np.repeat(np.arange(rows, rows + columns, dtype=kind)[:, None], len(a), 1)
    mask, held = np.empty_like(h), np.empty_like(h)
    for d in range(1 - rows, columns):
        # row r from the last meets column r + d
        lo, hi = max(0, -d), min(rows, columns - d)
        p, q, same, low = h[lo:hi], v[lo + d : hi + d], mask[: hi - lo], held[: hi - lo]
        np.negative((x[lo:hi] == y[lo + d : hi + d]).view(np.uint8).astype(kind, copy=False), out=same)
        np.bitwise_or(p, same, out=low)
        np.minimum(low, q, out=low)
        np.invert(same, out=same)
        np.bitwise_and(q, same, out=same)
        np.maximum(p, same, out=q)
        p[:] = low
    return v, n, m, rows


def _windows(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of each ``a`` against the windows of its ``b``, which is as long or longer. A window's characters without a match are the strands that enter and end within it."""
    v, n, m, first = _combed(a, b)
    columns, many = v.shape
    pair = np.arange(many)
    v, n, m = v.astype(np.int32) - first, n.astype(np.int32), m.astype(np.int32)
    v[np.arange(columns)[:, None] >= m] = -1
    ends = np.full((columns + 1, many), -1, np.int32)  # where a column's strand ends; the last row is for those of the rows
    ends[np.where(v < 0, columns, v), pair] = np.arange(columns)[:, None]
    best, lost = np.zeros(many), np.zeros(many, np.int32)
    for end in range(1, first + 1):
        inside = end <= n
        lost += (v[end - 1] >= 0) & inside
        np.maximum(best, np.where(inside, 200.0 * (end - lost) / (n + end), 0.0), out=best)
    end = n
    for start in range(1, columns):
        lost -= (v[start - 1] >= start - 1) | (ends[start - 1] >= start) & (ends[start - 1] < end)
        # both may leave: a strand that ends in the first column, and another that enters there
        lost -= (v[start - 1] >= start - 1) & (ends[start - 1] >= start) & (ends[start - 1] < end)
        more = np.minimum(start + n, m)
        lost += (more > end) & (v[np.minimum(end, columns - 1), pair] >= start)
        end = more
        size = end - start
        np.maximum(best, np.where(size > 0, 200.0 * (size - lost) / (n + np.maximum(size, 1)), 0.0), out=best)
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a tenth for each of the first four letters in common."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


def jaro_all(pairs: Pairs) -> np.ndarray:
    """``jaro_winkler`` of all pairs."""
    out = np.array([1.0 if a == b and a else 0.0 for a, b in pairs])
    sizes = [(0, 0) if a == b or not a or not b else (-(-len(b) // _WORD), len(a)) for a, b in pairs]
    for chunk in _chunks(sizes, out, lambda i: jaro_winkler(*pairs[i])):
        out[chunk] = _jaro_words([pairs[i] for i in chunk])
    return out


def _jaro_words(pairs: Pairs) -> np.ndarray:
    """``jaro_all`` of different pairs without empty strings whose second strings take equally many words."""
    places, steps, n, m = _places([y for _, y in pairs], [x for x, _ in pairs])
    reach = np.maximum(n, m) // 2 - 1
    used, one, mine = np.zeros((len(places), len(pairs)), np.uint64), np.uint64(1), []

    def first(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The lowest bit of a vector, and whether it has one."""
        some, out = np.zeros(len(pairs), bool), []
        for x in words:
            low = np.where(some, np.uint64(0), x & (~x + one))
            some = some | (low != 0)
            out.append(low)
        return out, some

    for i, at in enumerate(steps):
        free = [places[w].take(at) & ~used[w] & _below(i + reach + 1, w) & ~_below(i - reach, w) for w in range(len(places))]
        low, some = first(free)
        for w, bit in enumerate(low):
            used[w] |= bit
        mine.append(some)
    swaps, rest = np.zeros(len(pairs), np.int64), list(used)
    for at, some in zip(steps, mine):
        low, _ = first(rest)
        agree = np.zeros(len(pairs), bool)
        for w, bit in enumerate(low):
            agree |= (places[w].take(at) & bit) != 0
            rest[w] = np.where(some, rest[w] & ~bit, rest[w])
        swaps += some & ~agree
    found = sum(np.bitwise_count(x).astype(np.int64) for x in used)
    k = np.maximum(found, 1)
    jaro = np.where(found > 0, (k / m + k / n + (k - swaps // 2) / k) / 3, 0.0)
    same = np.array([next((j for j, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b))) for a, b in pairs])
    return np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)


#: Scorers of many pairs, by name.
SCORERS: dict[str, Callable[[Pairs], np.ndarray]] = {
    "ratio": ratio_all, "token_sort": sort_all, "token_set": set_all, "partial": partial_all, "jaro_winkler": jaro_all,
}


def _scored(scorer: str, x: pd.Series, y: pd.Series) -> np.ndarray:
    """The scorer on every distinct pair, dealt back to the rows."""
    number: dict[tuple[str, str], int] = {}
    rows = [number.setdefault(pair, len(number)) for pair in zip(x, y, strict=True)]
    return SCORERS[scorer](list(number))[rows] if rows else np.zeros(0)


#: Pair features: name, column of both records, scorer.
PAIR_SCORES = (
    ("name_ratio", "name_lat", "ratio"), ("name_tset", "name_lat", "token_set"), ("name_tsort", "name_lat", "token_sort"), ("name_part", "name_lat", "partial"),
    ("core_tset", "name_core", "token_set"), ("core_ratio", "name_core", "ratio"), ("skel_tset", "name_skel", "token_set"), ("name_jw", "name_lat", "jaro_winkler"),
    ("addr_tset", "addr_norm", "token_set"), ("addr_tsort", "addr_norm", "token_sort"), ("addr_part", "addr_norm", "partial"),
)


def score(scorer: str, a: Column, b: Column) -> Column:
    """One scorer of two string columns; null is empty."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_scored(scorer, x.fillna(""), y.fillna("")))

    return run(a, b)


def pair_scores(prefix_a: str = "a_", prefix_b: str = "b_", scores=PAIR_SCORES) -> Column:
    """A struct of all pair features from one Arrow round trip."""
    columns = sorted({c for _, c, _ in scores})
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n, _, _ in scores])

    @F.pandas_udf(kind)
    def run(*args: pd.Series) -> pd.DataFrame:
        sides = [s.fillna("") for s in args]
        left, right = dict(zip(columns, sides, strict=False)), dict(zip(columns, sides[len(columns) :], strict=True))
        return pd.DataFrame({name: _scored(scorer, left[column], right[column]) for name, column, scorer in scores}, dtype=float)

    return run(*(F.col(prefix_a + c) for c in columns), *(F.col(prefix_b + c) for c in columns))
