"""Toxicity by a small convolutional network over hashed word embeddings.

A word's hash picks one of 2**24 buckets; buckets that occur in the training
sample have an embedding, all others the zero vector. Filters of one, two and
three words slide over the text, the largest response of each is kept, and a
logistic layer scores them. Everything is trained in numpy, by Adam, on a
bounded sample of labelled documents.

The score is calibrated by language: part of the sample gives each language a
logistic curve (drawn towards the common one where it has few rows) and the
threshold of its best F1, which is moved to 0.3. The language is guessed from
the same words; the lang column only teaches that guess. A language with fewer
than ``LEAST`` sampled documents keeps the common curve.

At prediction the products of embeddings and filters are tables, so a
convolution is a few gathers and sums for each word. Whole texts are scored,
slice by slice; nothing is shuffled but the sample.

Defined results: null, empty and wordless texts have the responses of no
words; texts of any length are scored whole; without labels of both classes
every score is 0; equal texts, repeated rows too, have equal scores, whatever
their ids; an empty table gives none; columns of any name stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinfold.llm import labelled
from kinfold.llm import wordhash as W
from kinfold.llm.common import free_names
from kinfold.llm.quality import logistic

BUCKET_BITS = 24
#: Buckets with an embedding, at most; those in most documents of the sample stay.
ROWS = 1 << 16
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 12
EPOCHS, MINIBATCH, RATE, DECAY = 6, 64, 5e-3, 1e-4
#: Of ten sampled documents, this many train; the others calibrate.
TRAIN = 7
ACCEPT = 0.3
#: Rows at which a language's own curve weighs as much as the common one, and rows that it needs for one.
HALF, LEAST = 200, 8
#: Languages whose likelihoods are summed at a time.
SIDE = 32


@dataclass
class Model:
    buckets: np.ndarray  # sorted; row i + 1 of the tables
    tables: list[list[np.ndarray]]  # by width and place in the filter: rows x filters
    bias: np.ndarray
    out: np.ndarray
    base: float
    languages: list[str]
    words_by_language: np.ndarray  # log likelihoods, rows x languages
    curves: np.ndarray  # slope, intercept and threshold by language; the last: common

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return rows_of(self.buckets, hashes)

    def likelihoods(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Documents by languages."""
        out = np.zeros((len(first) - 1, len(self.languages)))
        some = np.flatnonzero(np.diff(first))
        for k in range(0, len(self.languages) if len(some) else 0, SIDE):
            out[some, k : k + SIDE] = np.add.reduceat(self.words_by_language[rows, k : k + SIDE], first[some], axis=0, dtype=np.float64)
        return out

    def score(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of documents whose words are rows[first[d]:first[d + 1]]."""
        n = len(first) - 1
        best = [pooled(rows, first, t, b) for t, b in zip(self.tables, np.split(self.bias, len(self.tables)), strict=True)]
        z = np.concatenate(best, axis=1) @ self.out + self.base
        which = np.full(n, len(self.languages))
        if self.languages and n:
            like = self.likelihoods(rows, first)
            which = np.where(like.any(axis=1), like.argmax(axis=1), which)
        slope, intercept, cut = self.curves[which].T
        return moved(1 / (1 + np.exp(-np.clip(slope * z + intercept, -500, 500))), cut)


def rows_of(buckets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 + the place of each hash's bucket, or 0."""
    if not len(buckets):
        return np.zeros(len(hashes), np.int64)
    b = (hashes >> W.U64(64 - BUCKET_BITS)).astype(np.int64)
    at = np.minimum(np.searchsorted(buckets, b), len(buckets) - 1)
    return np.where(buckets[at] == b, at + 1, 0)


def moved(p: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Scores with ``cut`` moved to ACCEPT, 0 and 1 kept."""
    return np.where(p < cut, p / cut * ACCEPT, ACCEPT + (p - cut) / (1 - cut) * (1 - ACCEPT))


def responses(rows: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Filter responses at every word, and the padded row numbers; words beyond a document are the zero vector."""
    width = len(tables)
    ends = np.repeat(first[1:], np.diff(first))
    x = tables[0][rows]
    taken = [rows]
    for j in range(1, width):
        at = np.arange(len(rows)) + j
        r = np.where(at < ends, rows[np.minimum(at, max(len(rows) - 1, 0))], 0)
        taken.append(r)
        x = x + tables[j][r]
    return x, np.stack(taken)


def pooled(rows: np.ndarray, first: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """The largest response of each filter and document, at least 0."""
    out = np.zeros((len(first) - 1, len(bias)), np.float32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        x, _ = responses(rows, first, tables)
        out[some] = np.maximum(np.maximum.reduceat(x, first[some], axis=0) + bias, 0)
    return out


class _Net:
    """Parameters and their training."""

    def __init__(self, n_rows: int, odds: np.ndarray, seed: int = 5):
        r = np.random.RandomState(seed)
        self.p = {"e": r.normal(0, 0.05, (n_rows, DIM)).astype(np.float32)}
        self.p["e"][:, 0] += odds
        self.p["e"][0] = 0
        for w in WIDTHS:
            f = r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32)
            f[:, 0] = np.abs(f[:, 0]) + 0.3
            self.p[f"f{w}"] = f
        self.p["b"] = np.full(FILTERS * len(WIDTHS), -0.2, np.float32)
        self.p["o"] = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.p["c"] = np.full(1, -2.0, np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.p["e"] @ self.p[f"f{w}"][j] for j in range(w)] for w in WIDTHS]

    def step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        rows = np.concatenate(docs)
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        pools, wins = [], []
        for k, w in enumerate(WIDTHS):
            x, taken = responses(rows, first, [self.p["e"] @ self.p[f"f{w}"][j] for j in range(w)])
            at = np.stack([a + x[a:b].argmax(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])
            top = np.take_along_axis(x, at, axis=0) + self.p["b"][k * FILTERS : (k + 1) * FILTERS]
            pools.append(top)
            wins.append(taken[:, at])  # place in filter x documents x filters
        h = np.maximum(np.concatenate(pools, axis=1), 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.p["o"] + self.p["c"], -60, 60)))
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["c"][0] = h.T @ d + DECAY * self.p["o"], d.sum()
        back = d[:, None] * self.p["o"] * (h > 0)
        g["b"] = back.sum(0)
        for k, w in enumerate(WIDTHS):
            b = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                r = wins[k][j]
                e = self.p["e"][r]  # documents x filters x dim
                g[f"f{w}"][j] = np.einsum("nf,nfd->df", b, e) + DECAY * self.p[f"f{w}"][j]
                np.add.at(g["e"], r, b[:, :, None] * self.p[f"f{w}"][j].T[None])
        g["e"][0] = 0
        self.t += 1
        for k in self.p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            self.p[k] -= RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1, between two scores."""
    order = np.argsort(-p)
    hit = np.cumsum((y * weight)[order])
    f = 2 * hit / (np.cumsum(weight[order]) + max((y * weight).sum(), 1e-9))
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f, -1)))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + low) / 2, 0.02, 0.98))


def sample_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the number of each text's; slice by slice, as hashing needs many times a slice's bytes."""
    hashes, sizes = [], []
    for _, rows in W.slices(W.as_strings(pa.array(texts, pa.large_string()))):
        w = W.split(rows, W.ALNUM)
        hashes.append(w.hash)
        sizes.append(np.diff(w.first))
    return np.concatenate(hashes), np.concatenate(sizes)


def fit(rows: list[tuple], counts: dict[int, int] | None = None) -> Model | None:
    """A model of (label, text, lang) rows; None without both classes. ``counts``: labelled documents of each class beyond the sample."""
    if len({r[0] for r in rows}) < 2:
        return None
    rows = [r for v in (1, 0) for r in [x for x in rows if x[0] == v]]
    y = np.array([r[0] for r in rows], float)
    hashes, size = sample_words([r[1] for r in rows])
    first = np.concatenate(([0], np.cumsum(size)))
    bucket = (hashes >> W.U64(64 - BUCKET_BITS)).astype(np.int64)
    n = len(rows)
    pairs = np.unique(bucket * n + np.repeat(np.arange(n), size)) if len(bucket) else np.zeros(0, np.int64)
    values, start, count = np.unique(pairs // n, return_index=True, return_counts=True)
    toxic = np.add.reduceat(y[pairs % n], start) if len(start) else start
    often = count >= (2 if n >= 100 else 1)
    order = np.lexsort((values, -count))
    order = np.sort(order[often[order]][:ROWS])
    buckets = values[order]
    odds = np.log((toxic[order] + 0.5) / (y.sum() + 1)) - np.log((count[order] - toxic[order] + 0.5) / (n - y.sum() + 1))
    odds = np.concatenate(([0.0], np.clip(odds, -3, 3) * np.minimum(count[order], 8) / 8 / 3)).astype(np.float32)
    r = rows_of(buckets, hashes)
    docs = [r[a:b] if b > a else np.zeros(1, np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
    mine = np.zeros(n, bool)
    for v in (0, 1):
        same = np.flatnonzero(y == v)
        mine[same[np.arange(len(same)) % 10 < TRAIN]] = True
    train, rest = np.flatnonzero(mine), np.flatnonzero(~mine)
    rest = rest if len({*y[rest]}) == 2 else train
    net, shuffle = _Net(len(buckets) + 1, odds), np.random.RandomState(3)
    # class weights that keep a third of the weight on the toxic documents
    weight = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-9) ** 0.5, 1.0)
    for _ in range(EPOCHS if len(train) > 1000 else 4 * EPOCHS):
        lot = shuffle.permutation(train)
        for a in range(0, len(lot), MINIBATCH):
            part = lot[a : a + MINIBATCH]
            net.step([docs[i] for i in part], y[part], weight[part])
    names, likes = language_words(rows, docs, len(buckets) + 1)
    model = Model(buckets, net.tables(), net.p["b"], net.p["o"], float(net.p["c"][0]), names, likes, np.array([[1.0, 0.0, 0.5]] * (len(names) + 1)))
    calibrate(model, [docs[i] for i in rest], y[rest], labelled.weights(y[rest], counts))
    return model


def language_words(rows: list[tuple], docs: list[np.ndarray], n_rows: int) -> tuple[list[str], np.ndarray]:
    """Languages of the sample and each word's log likelihood under them, less the mean; unknown words say nothing."""
    names = sorted(n for n, k in Counter(r[2] for r in rows).items() if n is not None and k >= LEAST)
    number = {n: i for i, n in enumerate(names)}
    count = np.full((n_rows, len(names)), 0.1, np.float32)
    for row, d in zip(rows, docs, strict=True):
        if row[2] in number:
            np.add.at(count[:, number[row[2]]], d, 1)
    count[0] = 1
    like = np.log(count / count.sum(0)) if names else count
    like = like - like.mean(1, keepdims=True) if names else like
    like[0] = 0
    return names, like.astype(np.float32)


def line(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve."""
    c = logistic(z[:, None], y, weight, 1.0)
    slope = c.weights[0] / c.spread[0]
    return float(slope), float(c.weights[1] - slope * c.mean[0])


def calibrate(model: Model, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
    rows = np.concatenate(docs)
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    best = [pooled(rows, first, t, b) for t, b in zip(model.tables, np.split(model.bias, len(model.tables)), strict=True)]
    z = np.concatenate(best, axis=1) @ model.out + model.base
    curve = lambda s, i, x: 1 / (1 + np.exp(-np.clip(s * x + i, -500, 500)))
    slope, intercept = line(z, y, weight)
    common = best_cut(curve(slope, intercept, z), y, weight)
    model.curves[-1] = slope, intercept, common
    if model.languages:
        which = model.likelihoods(rows, first).argmax(1)
    for k in range(len(model.languages)):
        x, t, w = z[which == k], y[which == k], weight[which == k]
        if len({*t}) < 2:
            model.curves[k] = model.curves[-1]
            continue
        share = len(t) / (len(t) + HALF)
        s, i = line(x, t, w)
        s, i = share * s + (1 - share) * slope, share * i + (1 - share) * intercept
        model.curves[k] = s, i, share * best_cut(curve(s, i, x), t, w) + (1 - share) * common


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", **bounds) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= 0.3) after its columns; where a name is taken, the new column is called ``toxicity_score`` or ``toxicity_predicted``."""
    # at most ROWS rows of filter responses, and of likelihoods for at most 2 * PER_CLASS / LEAST languages
    rows = labelled.sample(docs, labels, label_col, id_col, text_col, extra=(lang_col,), **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labelled.counts(labels, label_col, id_col)))
    names = [*docs.columns, *free_names(docs.columns, ["score", "predicted"], "toxicity")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = []
            for _, rows in W.slices(W.as_strings(batch.column(text_col))):
                w = W.split(rows, W.ALNUM)
                parts.append(model.score(model.rows(w.hash), w.first) if model else np.zeros(len(rows)))
            score = np.concatenate(parts).astype(float) if parts else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[-2], T.DoubleType()), T.StructField(names[-1], T.IntegerType())]))
