"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import held_out

#: A label is learned only from ids whose crc32 modulo 4 isn't this.
MOD, REST = 4, 2
#: Documents of a class, bytes of their texts together (and one text more), and bytes of a text that is fetched, at most.
PER_CLASS, CLASS_BYTES, TEXT_BYTES = 2000, 12 << 20, 1 << 20
SEED = 11


def dealt(id_col: str) -> Column:
    """A fixed pseudo-random order of ids."""
    return F.xxhash64(F.col(id_col), F.lit(SEED))


def _labels(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """__id and __label (the smallest) of ids outside the held-out fold."""
    own = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label"))
    own = own.where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out("__id", MOD, REST))
    return own.groupBy("__id").agg(F.min("__label").alias("__label"))


def counts(labels: DataFrame, label_col: str, id_col: str) -> dict[int, int]:
    """Labelled ids of each class outside the held-out fold."""
    return {r[0]: r[1] for r in _labels(labels, label_col, id_col).groupBy("__label").count().collect()}


def weights(y: np.ndarray, counts: dict[int, int] | None) -> np.ndarray:
    """A weight for each sampled label, so that classes weigh as they do among all labels; 1 on average."""
    if not counts:
        return np.ones(len(y))
    total = sum(counts.values())
    share = {v: counts.get(v, 0) / total / max((y == v).mean(), 1e-9) for v in (0, 1)}
    return np.where(y == 1, share[1], share[0])


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES, text_bytes: int = TEXT_BYTES, extra: tuple[str, ...] = ()) -> list[tuple]:
    """(label, text, *extra) of at most ``per_class`` whole documents of each class outside the held-out fold.

    A class's documents are those that come first in a fixed pseudo-random
    order of ids, up to ``class_bytes`` of text. An id with several labels
    counts with the smallest; null labels and texts and texts of more than
    ``text_bytes`` don't count.
    """
    one = _labels(labels, label_col, id_col)
    few = None
    for value in (0, 1):
        part = one.where(F.col("__label") == value).orderBy(dealt("__id"), "__id").limit(per_class)
        few = part if few is None else few.unionByName(part)
    names = [f"__extra{i}" for i in range(len(extra))]
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(n) for c, n in zip(extra, names, strict=True))).where(F.octet_length("__text") <= text_bytes)
    # at most 2 * per_class ids: the size of what is broadcast is known
    rows = text.join(F.broadcast(few), "__id").orderBy(dealt("__id"), "__id", "__text").select("__label", "__text", *names)
    out, size = [], {0: 0, 1: 0}
    for row in rows.toLocalIterator():
        if size[row[0]] < class_bytes:
            size[row[0]] += len(row[1].encode())
            out.append(tuple(row))
    return out
