"""Scores of match lists and where matches were lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_half(n_pred: str, n_true: str, tp: str) -> Column:
    """F0.5 of one query from counts: 1 if both lists are empty, 0 without a hit."""
    p, r = F.col(tp) / F.greatest(F.col(n_pred), F.lit(1)), F.col(tp) / F.greatest(F.col(n_true), F.lit(1))
    none = (F.col(n_pred) == 0) & (F.col(n_true) == 0)
    return F.when(none, F.lit(1.0)).when(F.col(tp) == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))


def by_query(s1: DataFrame, chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """country, s1_id, n_pred, n_true, tp, f05 for every S1 row; ``chosen`` and ``truth`` hold s1_id, rec_id."""
    both = chosen.select("s1_id", "rec_id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("s1_id", "rec_id", F.lit(0).alias("p"), F.lit(1).alias("t")))
    pair = both.groupBy("s1_id", "rec_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    counts = pair.groupBy("s1_id").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"), F.sum(F.col("p") * F.col("t")).alias("tp"))
    out = s1.select("country", "s1_id").join(counts, "s1_id", "left").fillna(0, ["n_pred", "n_true", "tp"])
    return out.select("country", "s1_id", "n_pred", "n_true", "tp", F.round(f_half("n_pred", "n_true", "tp"), 6).alias("f05"))


def macro(scored: DataFrame, *by: str) -> DataFrame:
    """Mean F0.5 over all queries or by columns."""
    aggs = (F.round(F.avg("f05"), 6).alias("macro_f05"), F.count("*").alias("n"))
    return scored.groupBy(*by).agg(*aggs)


def by_size(scored: DataFrame, most: int = 6) -> DataFrame:
    """Mean F0.5 by the number of true records, ``most`` and more together."""
    return macro(scored.withColumn("n_true_bin", F.least(F.col("n_true"), F.lit(most))), "n_true_bin")


def view_recall(candidates: DataFrame, truth: DataFrame, views: dict[str, Column]) -> DataFrame:
    """By country: true pairs and how many of them each view and their union found."""
    ids = ["country", "src", "s1_id", "rec_id"]
    hit = candidates.select(*ids, *(c.cast("int").alias(n) for n, c in views.items()), F.lit(1).alias("union"))
    marked = truth.select(*ids).join(hit, ids, "left").fillna(0)
    share = lambda n: F.round(F.sum(n) / F.count("*"), 6).alias(f"recall_{n}")
    return marked.groupBy("country").agg(F.count("*").alias("n_true"), *(share(n) for n in [*views, "union"]))


def ceiling(s1: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """By country: the F0.5 of a perfect choice among the candidates, the shares of queries fully found and without any hit."""
    found = truth.join(candidates.select("s1_id", "rec_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "rec_id"], "left")
    r = found.groupBy("s1_id").agg(F.count("*").alias("n_true"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    every = s1.select("country", "s1_id").join(r, "s1_id", "left").fillna(0, ["n_true", "hits"])
    recall = F.col("hits") / F.greatest(F.col("n_true"), F.lit(1))
    best = F.when(F.col("n_true") == 0, 1.0).when(F.col("hits") == 0, 0.0).otherwise(1.25 * recall / (0.25 + recall))
    some = F.col("n_true") > 0
    rate = lambda c: F.round(F.coalesce(F.sum(F.when(some & c, 1.0).otherwise(0.0)) / F.nullif(F.sum(some.cast("int")), F.lit(0)), F.lit(0.0)), 6)
    return every.groupBy("country").agg(
        F.count("*").alias("n"), F.round(F.avg(best), 6).alias("ceiling"), rate(F.col("hits") == F.col("n_true")).alias("fully_recovered"), rate(F.col("hits") == 0).alias("zero_hit"),
    )


def taxonomy(truth: DataFrame, retrieved: DataFrame, pruned: DataFrame, chosen: DataFrame) -> DataFrame:
    """``truth`` with fate: hit, a_not_retrieved, b_pruned_away or c_scored_low."""
    ids = ["s1_id", "rec_id"]
    mark = lambda df, n: df.select(*ids).distinct().withColumn(n, F.lit(1))
    out = truth
    for df, n in ((retrieved, "__r"), (pruned, "__p"), (chosen, "__c")):
        out = out.join(mark(df, n), ids, "left")
    fate = F.when(F.col("__c").isNotNull(), "hit").when(F.col("__r").isNull(), "a_not_retrieved").when(F.col("__p").isNull(), "b_pruned_away").otherwise("c_scored_low")
    return out.withColumn("fate", fate).drop("__r", "__p", "__c")


def fate_shares(fates: DataFrame, *by: str) -> DataFrame:
    """Counts and shares of fates by columns."""
    names = ["hit", "a_not_retrieved", "b_pruned_away", "c_scored_low"]
    wide = fates.groupBy(*by).pivot("fate", names).count().fillna(0, names)
    total = sum((F.col(n) for n in names), F.lit(0))
    return wide.withColumn("n", total).withColumns({f"share_{n}": F.round(F.col(n) / total, 6) for n in names})


def false_positives(chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """Chosen pairs that aren't true, by country."""
    return chosen.join(truth.select("s1_id", "rec_id"), ["s1_id", "rec_id"], "left_anti").groupBy("country").agg(F.count("*").alias("false_positives"))


def owned_outside(pairs: DataFrame, owner: DataFrame, s1: DataFrame) -> DataFrame:
    """``pairs`` with oth: 1 if the record's owner exists but isn't among these S1 rows."""
    away = owner.where("owner <> ''").join(s1.select(F.col("s1_id").alias("owner")), "owner", "left_anti").select("rec_id").withColumn("oth", F.lit(1).cast("long"))
    return pairs.join(away, "rec_id", "left").fillna(0, ["oth"])
