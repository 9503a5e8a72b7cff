"""From pair probabilities to one owner a record and a list of records a query."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAP = 11
MISS_RATE = 0.03
#: Numbers that a batch of expected scores holds at once.
CELLS = 4_000_000


def one_owner(pairs: DataFrame, prob: str = "prob", margin: float = 0.0) -> DataFrame:
    """Each record keeps its most probable query (ties: the smallest id), if it leads the next by ``margin``."""
    w = Window.partitionBy("rec_id", "src", "country").orderBy(F.desc(prob), "s1_id")
    out = pairs.withColumn("__n", F.row_number().over(w))
    if margin > 0:
        out = out.withColumn("__lead", F.round(F.col(prob) - F.coalesce(F.lead(prob).over(w), F.lit(0.0)), 9)).where(F.col("__lead") >= margin).drop("__lead")
    return out.where("__n = 1").drop("__n")


def cap_per_query(pairs: DataFrame, cap: int = CAP, prob: str = "prob") -> DataFrame:
    """At most ``cap`` records a query, the most probable ones."""
    w = Window.partitionBy("s1_id", "country").orderBy(F.desc(prob), "src", "rec_id")
    return pairs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def by_threshold(pairs: DataFrame, threshold: float, prob: str = "prob") -> DataFrame:
    return pairs.where(F.col(prob) >= threshold)


def expected_scores(p: np.ndarray, miss_rate: float = 0.0) -> np.ndarray:
    """The expected F0.5 of taking the first k records, k = 0 to n, for independent matches of falling probability ``p``: n values, or a row of n for each list.

    Exact, for lists of any length: with h true matches among the first k
    records and m others, F0.5 is 5 h / (4 k + h + m). Records join the first
    k one by one, which gives the chances of h, and leave the rest one by one
    from the end, which gives the mean of 1 / (i + m) for every i; an
    unretrieved match adds ``miss_rate``. The empty list scores the chance
    that nothing matches. A list takes n * n steps; of the chances of h every
    root(n)-th row is kept and the rows between are made again, so it holds
    n * root(n) numbers. Zeros at the end of a list change no other score.
    """
    p = np.asarray(p, float)
    lists = p if p.ndim == 2 else p[None]
    g, n = lists.shape
    step = math.isqrt(n) + 1

    def add(dist: np.ndarray, k: int) -> np.ndarray:
        q = lists[:, k, None]
        out = np.zeros((g, dist.shape[1] + 1))
        out[:, :-1] = dist * (1 - q)
        out[:, 1:] += dist * q
        return out

    head, kept = np.ones((g, 1)), []
    for k in range(n):
        if k % step == 0:
            kept.append(head)
        head = add(head, k)
    out = np.empty((g, n + 1))
    out[:, 0] = head[:, 0] * (1 - miss_rate)
    i = np.arange(1, 5 * n + 1)
    rest = np.broadcast_to((1 - miss_rate) / i + miss_rate / (i + 1), (g, 5 * n))  # beyond the first k: the mean of 1 / (i + m)
    for first in reversed(range(0, n, step)):
        heads = [kept.pop()]
        for k in range(first, min(first + step, n)):
            heads.append(add(heads[-1], k))
        for k in reversed(range(first + 1, first + len(heads))):
            hits = heads.pop()[:, 1:] * np.arange(1, k + 1)
            out[:, k] = 5 * (hits * rest[:, 4 * k : 5 * k]).sum(axis=1)
            q = lists[:, k - 1, None]
            rest = rest[:, : 5 * k - 5] * (1 - q) + rest[:, 1 : 5 * k - 4] * q
    return out if p.ndim == 2 else out[0]


def _best_prefixes(p: np.ndarray, sizes: np.ndarray, most: int | None, miss_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Of lists one after another in ``p``: how many records of each to take, and the expected F0.5 of these. Lists of like sizes are scored together, the shorter ones filled up with zeros."""
    taken, value = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
    starts, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n = int(sizes[order[at]])
        some = order[at : at + max(1, CELLS // ((n + 1) * (math.isqrt(n) + 16)))]
        at += len(some)
        place = np.arange(n)[None]
        real = place < sizes[some, None]
        lists = np.zeros(real.shape)
        lists[real] = p[(starts[some, None] + place)[real]]
        scores = expected_scores(lists, miss_rate).round(9)
        ends = sizes[some] if most is None else np.minimum(sizes[some], most)
        scores[np.arange(n + 1)[None] > ends[:, None]] = -1
        taken[some], value[some] = scores.argmax(axis=1), scores.max(axis=1)
    return taken, value


def expected_selection(pairs: DataFrame, prob: str = "prob", most: int | None = None, miss_rate: float = MISS_RATE) -> DataFrame:
    """The prefix of each query's records, by falling probability, of the best expected F0.5; expected_f is its value.

    All records of a query count, however many. ``most`` bounds the prefix
    alone: records beyond it can't be taken, but are among those that may be
    missed. A query's probabilities become one array, so a batch holds many
    queries and no group is sent to Python alone.
    """
    row = F.struct((-F.col(prob)).alias("o"), "src", "rec_id", F.col(prob).alias("p"))
    lists = pairs.groupBy("country", "s1_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            p = rows.flatten().field("p").cast(pa.float64()).to_numpy(zero_copy_only=False)
            taken, value = _best_prefixes(p, rows.value_lengths().to_numpy(zero_copy_only=False), most, miss_rate)
            yield pa.record_batch([*batch.columns, pa.array(taken, pa.int32()), pa.array(value, pa.float64())], names=[*batch.schema.names, "k", "expected_f"])

    kinds = {f.name: f.dataType.simpleString() for f in lists.schema.fields}
    chosen = lists.mapInArrow(choose, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", k int, expected_f double")
    flat = chosen.where("k > 0").select("country", "s1_id", "expected_f", F.explode(F.slice("rows", 1, F.col("k"))).alias("r"))
    return flat.select("country", "s1_id", "r.src", "r.rec_id", F.col("r.p").alias(prob), F.round("expected_f", 6).alias("expected_f"))


def select(pairs: DataFrame, mode: str = "threshold", threshold: float = 0.5, margin: float = 0.0, cap: int = CAP, miss_rate: float = MISS_RATE, prob: str = "prob") -> DataFrame:
    """One owner, then at most ``cap`` records of a threshold or of the best expected score, for which the records beyond the cap count too."""
    own = one_owner(pairs, prob, margin)
    return expected_selection(own, prob, cap, miss_rate) if mode == "expected" else by_threshold(cap_per_query(own, cap, prob), threshold, prob)


def match_lists(s1: DataFrame, chosen: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row for every S1 id with its sorted record ids, comma-joined; blank without any."""
    lists = chosen.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("rec_id")), ",").alias(name))
    return s1.select("s1_id").join(lists, "s1_id", "left").fillna("", [name])


def mutual_best(pairs: DataFrame, prob: str = "prob", sure: float = 0.98, unsure: float = 0.5, wrong: int = 2) -> DataFrame:
    """Pseudo-labels: pairs of at least ``sure`` that are best for both sides (y 1), and of those queries up to ``wrong`` pairs under ``unsure`` (y 0)."""
    rec, s1 = (Window.partitionBy("country", "src", c).orderBy(F.desc(prob), o) for c, o in (("rec_id", "s1_id"), ("s1_id", "rec_id")))
    ranked = pairs.withColumn("__r", F.row_number().over(rec)).withColumn("__s", F.row_number().over(s1))
    good = ranked.where((F.col("__r") == 1) & (F.col("__s") == 1) & (F.col(prob) >= sure)).select(*pairs.columns)
    least = Window.partitionBy("country", "s1_id").orderBy(F.desc(prob), "src", "rec_id")
    bad = pairs.where(F.col(prob) < unsure).join(good.select("country", "s1_id").distinct(), ["country", "s1_id"], "left_semi")
    bad = bad.withColumn("__n", F.row_number().over(least)).where(F.col("__n") <= wrong).drop("__n")
    return good.withColumn("y", F.lit(1).cast("long")).unionByName(bad.withColumn("y", F.lit(0).cast("long")))


def tune(pairs: DataFrame, truth: DataFrame, s1: DataFrame, thresholds: list[float], margins: list[float], prob: str = "prob", cap: int = CAP) -> DataFrame:
    """threshold, margin and the macro F0.5 of each combination, in one pass over the pairs.

    ``truth``: s1_id, rec_id. The grid is a short list of parameters, exploded
    beside each record's owner.
    """
    w = Window.partitionBy("country", "src", "rec_id").orderBy(F.desc(prob), "s1_id")
    lead = F.round(F.col(prob) - F.coalesce(F.lead(prob).over(w), F.lit(0.0)), 9)
    own = pairs.withColumn("__lead", lead).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    hit = truth.select("s1_id", "rec_id", F.lit(1).alias("hit"))
    own = own.join(hit, ["s1_id", "rec_id"], "left")
    grid = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(m)).alias("margin")) for t in thresholds for m in margins))
    long = own.select("country", "s1_id", "src", "rec_id", prob, "__lead", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(grid).alias("g"))
    long = long.where(F.col("__lead") >= F.col("g.margin"))
    capped = Window.partitionBy("country", "s1_id", "g").orderBy(F.desc(prob), "src", "rec_id")
    long = long.withColumn("__n", F.row_number().over(capped)).where((F.col("__n") <= cap) & (F.col(prob) >= F.col("g.threshold")))
    got = long.groupBy("s1_id", "g").agg(F.count("*").alias("n_pred"), F.sum("hit").alias("tp"))
    true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    every = s1.select("s1_id", F.explode(grid).alias("g")).join(true, "s1_id", "left").join(got, ["s1_id", "g"], "left").fillna(0, ["n_true", "n_pred", "tp"])
    from kinfold.operators.evaluate import f_half

    return every.groupBy("g").agg(F.round(F.avg(f_half("n_pred", "n_true", "tp")), 6).alias("macro_f05")).select("g.threshold", "g.margin", "macro_f05")
