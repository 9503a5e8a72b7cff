"""Splitting glued names by a vocabulary mined from clean names."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_WORD, LEAST_GLUED, LEAST_PART, MOST_PARTS = 3, 10, 3, 4
#: Gain of a letter against the cost of a rarer word.
LENGTH_GAIN = 0.9
#: A parameter of ``collected``: words of the vocabulary that is sent to the executors; the most frequent ones.
VOCABULARY = 500_000


def vocabulary(names: DataFrame, name_col: str = "business_name", min_count: int = 10) -> DataFrame:
    """(word, n) of letter runs of at least three letters in raw names, by falling count."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(F.col(name_col), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    words = names.select(F.explode(F.filter(runs, lambda w: F.length(w) >= LEAST_WORD)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def collected(vocab: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """The most frequent words with their counts, on the driver; at most ``most``."""
    return {r["word"]: r["n"] for r in vocab.orderBy(F.desc("n"), "word").limit(most).collect()}


class Splitter:
    """The cheapest split of a glued token into known words, by dynamic programming over its ends."""

    def __init__(self, vocab: Mapping[str, int], least_glued: int = LEAST_GLUED, least_part: int = LEAST_PART, most_parts: int = MOST_PARTS, gain: float = LENGTH_GAIN, word_cost: float = 0.0):
        total = sum(vocab.values()) or 1
        self.cost = {w: math.log(total / n) - gain * len(w) + word_cost for w, n in vocab.items()}
        self.longest = max(map(len, vocab), default=0)
        self.least_glued, self.least_part, self.most_parts = least_glued, least_part, most_parts

    def parts(self, token: str) -> list[str] | None:
        """At least two words, or None where the token stays whole.

        Words are laid from the left: ``best[k][at]`` is the cheapest way to
        reach the place ``at`` in k words, and where the last of them began.
        """
        if len(token) < self.least_glued or token in self.cost:
            return None
        best: list[dict[int, tuple[float, int]]] = [{0: (0.0, 0)}]
        for _ in range(self.most_parts):
            reached: dict[int, tuple[float, int]] = {}
            for at, (spent, _) in best[-1].items():
                for word in (token[at:end] for end in range(at + self.least_part, min(len(token), at + self.longest) + 1)):
                    price = self.cost.get(word)
                    if price is not None:
                        end = at + len(word)
                        reached[end] = min(reached.get(end, (math.inf, 0)), (spent + price, at))
            best.append(reached)
        ways = [(layer[len(token)][0], k) for k, layer in enumerate(best) if k > 1 and len(token) in layer]
        if not ways:
            return None
        words, end = [], len(token)
        for layer in best[min(ways)[1] : 0 : -1]:
            begin = layer[end][1]
            words.append(token[begin:end])
            end = begin
        return words[::-1]

    def text(self, text: str) -> str:
        out = []
        for token in text.split(" "):
            out += (self.parts(token) if token.isalpha() else None) or [token]
        return " ".join(out)


def segmented(name: Column, splitter: Splitter) -> Column:
    """``name`` with glued tokens split; the splitter is broadcast."""

    @F.pandas_udf(T.StringType())
    def run(names: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return names.fillna("").map(lambda s: known.get(s) or known.setdefault(s, splitter.text(s)))

    return run(name)


def segment_key(segmented_name: Column) -> Column:
    """Sorted distinct words of a segmented name."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(segmented_name, " "), lambda w: w != ""))), " ")


def handle_splitter(vocab: Mapping[str, int]) -> Splitter:
    """The older variant: shorter glued tokens, and a price for every word instead of a gain for its letters."""
    return Splitter(vocab, least_glued=8, most_parts=8, gain=0.0, word_cost=3.0)


def segmented_handles(raw: Column, name: Column, splitter: Splitter) -> Column:
    """``name`` split only where the raw name looks like a domain, a handle or a web address."""
    handle = F.coalesce(raw, F.lit("")).rlike(r"(?i)(\.(com|net|org|in|fr|io)\b|@|www\.)")
    return F.when(handle, segmented(name, splitter)).otherwise(name)
