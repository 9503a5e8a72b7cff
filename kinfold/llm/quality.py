"""Quality by compression.

Two zstandard dictionaries are built from documents labelled good and bad.
A text is cut into blocks and each block is compressed with either. How much
smaller the good dictionary makes it, normalised by the text's bytes, says
whose vocabulary and form the text shares: the difference. A logistic curve
fitted on labelled documents that built neither dictionary makes it a score.
The curve's second variable is the smaller of the two sizes, as a text that
shrinks under any dictionary (copies of one word) has a small difference
whatever it says. Classes weigh as they do among all labels.

The labelled sample is bounded (``labelled.PER_CLASS``, ``CLASS_BYTES``,
``TEXT_BYTES``); every text is scored whole, whatever its length. Nothing is
shuffled but the sample.

Defined results: a null or empty text has difference 0 and the score of the
point 0, 0.5; without labels of both classes every score is 0.5; equal texts,
repeated rows too, have equal scores, whatever their ids; an empty table gives
none; columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinfold.llm import labelled
from kinfold.llm import wordhash as W
from kinfold.llm.common import free_names

BLOCK = 1024
FEATURES = 2
DICTIONARY_BYTES = 48 << 10
LEVEL = 3
#: Bytes at which a text's own sizes weigh half.
HALF_SURE = 200
#: Of five sampled documents, this many build dictionaries; the others fit the curve.
BUILD = 3
ACCEPT = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: Curve | None = None


def blocks(raw: memoryview | bytes) -> Iterator[bytes]:
    for a in range(0, len(raw), BLOCK):
        yield raw[a : a + BLOCK]


def dictionary(texts: list[bytes]) -> bytes:
    parts = [bytes(b) for t in texts for b in blocks(t)]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, parts)) // 4))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: their own bytes serve
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.with_good, self.with_bad = (self._compressor(d) for d in (model.good, model.bad))

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)

    def features(self, raw: memoryview | bytes) -> tuple[float, float]:
        """(bad - good) / bytes and min(bad, good) / bytes; a short text's are drawn towards 0 and 0.5."""
        good = bad = 0
        for b in blocks(raw):
            good, bad = good + len(self.with_good.compress(b)), bad + len(self.with_bad.compress(b))
        if not good:
            return 0.0, 0.5
        sure = len(raw) / (len(raw) + HALF_SURE)
        return sure * (bad - good) / len(raw), sure * min(bad, good) / len(raw) + (1 - sure) / 2


@dataclass
class Curve:
    """A logistic curve of several features."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last: intercept

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.05) -> Curve:
    """The likeliest curve of rows of features, by damped Newton steps on standardised features."""
    weight = np.ones(len(y)) if weight is None else weight
    mean, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    loss = lambda v: (weight * np.logaddexp(0, -(2 * y - 1) * (z @ v))).sum() + ridge * v @ v / 2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (p - y)) + ridge * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return Curve(mean, spread, w)


def fit(rows: list[tuple], counts: dict[int, int] | None = None) -> Model | None:
    """A model of (label, text) rows; None without both classes. ``counts``: labelled documents of each class beyond the sample."""
    good, bad = ([r[1].encode() for r in rows if r[0] == v] for v in (1, 0))
    if not good or not bad:
        return None
    part = lambda texts: ([t for i, t in enumerate(texts) if i % 5 < BUILD], [t for i, t in enumerate(texts) if i % 5 >= BUILD] or texts)
    (good, good_left), (bad, bad_left) = part(good), part(bad)
    model = Model(dictionary(good), dictionary(bad))
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t in good_left + bad_left])
    y = np.array([1.0] * len(good_left) + [0.0] * len(bad_left))
    model.curve = logistic(x, y, labelled.weights(y, counts))
    return model


def _scored(model: Model | None, texts: pa.Array, scorer: Scorer | None) -> tuple[np.ndarray, np.ndarray]:
    """Difference and score of each text."""
    data, at = W.bytes_of(texts)
    if not scorer:
        return np.zeros(len(at) - 1), np.full(len(at) - 1, 0.5)
    view = memoryview(data)
    x = np.array([scorer.features(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], float).reshape(-1, FEATURES)
    return x[:, 0], model.curve(x)


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, **bounds) -> Model | None:
    return fit(labelled.sample(docs, labels, label_col, id_col, text_col, **bounds), labelled.counts(labels, label_col, id_col))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds) -> DataFrame:
    """``docs`` with difference, score and predicted (1 if score >= 0.7) after its columns; where a name is taken, the new column is called ``quality_score`` and so on."""
    model = _learned(docs, labels, id_col, text_col, label_col, **bounds)
    names = [*docs.columns, *free_names(docs.columns, ["difference", "score", "predicted"], "quality")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            d, score = _scored(model, W.as_strings(batch.column(text_col)), scorer)
            yield pa.record_batch([*batch.columns, pa.array(d), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], names=names)

    kinds = (T.DoubleType(), T.DoubleType(), T.IntegerType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names[-3:], kinds, strict=True))]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds) -> DataFrame:
    """The rows that aren't rejected, every column as it is; rows leave where they are scored."""
    model = _learned(docs, labels, id_col, text_col, label_col, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            yield batch.filter(pa.array(_scored(model, W.as_strings(batch.column(text_col)), scorer)[1] >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
