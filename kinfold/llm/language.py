"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (one to three
letters, words bounded by a blank) by rank. A document's own list is compared
with each: an n-gram counts the difference of its ranks, or the length of a
list where the profile lacks it. The least out-of-place distance wins.

Profiles come from a bounded sample of each language's labelled documents,
made where these are; only the lists of n-grams come to the driver. Each
document's list comes from its whole text. All n-grams of a slice of documents
are counted by one sort of 64-bit keys.

Defined results: a null or empty text and one without letters are ``und`` with
score 0; texts of any length are read whole; ties go to the first language by
name; equal texts, repeated rows too, have equal results; without labelled
texts every document is ``und``; an empty table gives none; no column but id,
text and (to learn) language is read, so names of others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.llm import wordhash as W
from kinfold.llm.common import held_out, materialize

MOD, REST = 3, 1
TOP = 300
LONGEST = 3
#: Documents of a language that its profile is made of, bytes of their texts together (and one text more), and bytes of a text that is taken, at most.
PER_LANGUAGE, LANGUAGE_BYTES, TEXT_BYTES = 400, 2 << 20, 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ranked(texts: list[str], top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, rank, n-gram, alphabet): every document's ``top`` n-grams in order; an n-gram is its letters' numbers in the alphabet (0: blank), most significant first, below its length."""
    lowered = [t.lower() for t in texts]
    doc_at = np.concatenate(([0], np.cumsum([len(t) + 2 for t in lowered])))
    points = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[points]
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # the first blank after letters
    keep[doc_at[:-1]] = True  # and the one that begins a document
    where = np.flatnonzero(keep)
    doc = np.searchsorted(doc_at, where, "right") - 1
    seen = np.zeros(0x110000, bool)
    seen[points[alpha]] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.uint64)
    number[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint64)
    x = np.where(alpha[where], number[points[where]], np.uint64(0))
    bits = np.uint64(max(1, int(len(alphabet)).bit_length()))
    size = np.uint64(LONGEST) * bits + np.uint64(2)
    keys = []
    for n in range(1, LONGEST + 1):
        if len(x) < n:
            break
        m = len(x) - n + 1
        code, ok = np.full(m, n, np.uint64), doc[:m] == doc[n - 1 :]
        ok &= (x[:m] > 0) if n == 1 else np.ones(m, bool)
        for j in range(n):
            part = x[j : j + m]
            code = (code << bits) | part
            if 0 < j < n - 1:
                ok &= part > 0
        if n == 2:
            ok &= (x[:m] > 0) | (x[1:] > 0)
        keys.append((doc[:m][ok].astype(np.uint64) << size) | code[ok])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    owner = (key >> size).astype(np.int64)
    order = np.lexsort((key, -count, owner))
    owner, gram = owner[order], key[order] & ((np.uint64(1) << size) - np.uint64(1))
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    some = rank < top
    return owner[some], rank[some], gram[some], alphabet


def spelled(gram: int, alphabet: np.ndarray) -> str:
    """An n-gram's letters, blanks included."""
    bits = max(1, int(len(alphabet)).bit_length())
    out = ""
    while gram >> bits:
        n = gram & ((1 << bits) - 1)
        out = (chr(alphabet[n - 1]) if n else " ") + out
        gram >>= bits
    return out


def profile(texts: list[str], top: int = TOP) -> list[str]:
    """The most frequent n-grams of all texts together."""
    _, _, gram, alphabet = ranked([" ".join(texts)], top)
    return [spelled(int(g), alphabet) for g in gram]


class Profiles:
    def __init__(self, by_language: dict[str, list[str]], top: int = TOP):
        self.names = sorted(by_language)
        self.lists, self.top = [by_language[n] for n in self.names], top

    def _codes(self, alphabet: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each profile's n-grams that the alphabet can spell, sorted, with their ranks."""
        bits = max(1, int(len(alphabet)).bit_length())
        number = {chr(c): i + 1 for i, c in enumerate(alphabet)} | {" ": 0}
        out = []
        for grams in self.lists:
            codes = []
            for rank, g in enumerate(grams):
                if all(c in number for c in g):
                    code = len(g)
                    for c in g:
                        code = (code << bits) | number[c]
                    codes.append((code, rank))
            codes.sort()
            out.append((np.array([c for c, _ in codes], np.uint64), np.array([r for _, r in codes], np.int64)))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """By text, the language and the score: the lead over the next language as a share of its distance."""
        doc, rank, gram, alphabet = ranked(texts, self.top)
        size = np.bincount(doc, minlength=len(texts))
        far = np.zeros((len(texts), len(self.names)))
        for k, (codes, ranks) in enumerate(self._codes(alphabet)):
            away = np.full(len(gram), self.top)
            if len(codes):
                at = np.minimum(np.searchsorted(codes, gram), len(codes) - 1)
                away = np.where(codes[at] == gram, np.minimum(np.abs(ranks[at] - rank), self.top), self.top)
            far[:, k] = np.bincount(doc, away, len(texts))
        far /= np.maximum(size, 1)[:, None] * self.top
        best = far.argmin(1) if self.names else np.zeros(len(texts), int)
        score = np.zeros(len(texts))
        if len(self.names) > 1:
            near = np.partition(far, 1, axis=1)
            score = (near[:, 1] - near[:, 0]) / np.maximum(near[:, 1], 1e-12)
        elif self.names:
            score = 1 - far[:, 0]
        known = (size > 0) & bool(self.names)
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0)


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, language_bytes: int = LANGUAGE_BYTES, text_bytes: int = TEXT_BYTES,
) -> Profiles:
    """Profiles of every language of documents outside the held-out fold, from ``per_language`` whole texts of each, the first in a fixed pseudo-random order of distinct rows."""
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    own = own.where(F.col("lang").isNotNull() & (F.octet_length("text") <= text_bytes) & ~held_out("id", MOD, REST)).withColumn("lot", F.xxhash64("id", "text"))
    # about four times as many as are wanted go on from a large language, so that no group grows with it
    size = materialize(own.groupBy("lang").agg(F.approx_count_distinct("lot").alias("n")), "languages")
    near = own.select("lang", "lot").join(size, "lang").where(F.pmod("lot", F.lit(1 << 30)) < F.lit(4.0 * per_language * (1 << 30)) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("place")
    near = near.select("lang", F.pmod("lot", F.lit(1 << 30)).alias("place")).distinct()
    last = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).groupBy("lang").agg(F.max("place").alias("last"))
    few = own.join(materialize(last, "language-lots"), "lang").where(F.pmod("lot", F.lit(1 << 30)) <= F.col("last")).select("lang", "lot", "text").dropDuplicates(["lang", "lot"])

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lot", "ascending"), ("text", "ascending")])
        texts, size = [], 0
        for t in table.column("text").to_pylist()[:per_language]:
            if size < language_bytes:
                texts.append(t)
                size += len(t.encode())
        return pa.table({"lang": [table.column("lang")[0].as_py()], "grams": pa.array([profile(texts)], pa.list_(pa.string()))})

    made = few.groupBy("lang").applyInArrow(make, "lang string, grams array<string>").where(F.size("grams") > 0)
    return Profiles({r["lang"]: list(r["grams"]) for r in made.toLocalIterator()})


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # TOP n-grams a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            names, scores = [], []
            for _, rows in W.slices(W.as_strings(batch.column("text"))):
                n, s = profiles.predict(rows.to_pylist())
                names += n
                scores.append(s)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")
