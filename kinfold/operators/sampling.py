"""Splits and samples that depend on ids alone, so that they survive any repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 1_000_000


def lot(*ids: str, seed: int = 0) -> Column:
    """A number in [0, 1) from the ids and a seed."""
    return F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(SCALE)) / F.lit(float(SCALE))


def group_of(id_number: Column, groups: int = 5, seed: int = 0) -> Column:
    """(id + seed) modulo the number of groups: 0 train, 1 validate, 2 calibrate, ..."""
    return F.pmod(id_number + F.lit(seed), F.lit(groups)).cast("long")


def splits(df: DataFrame, id_col: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``df`` with split: disjoint slices of one fixed order of ids; null beyond the last slice."""
    out, upto = F.lit(None).cast("string"), sum(shares.values())
    for name, share in reversed(shares.items()):
        out = F.when(lot(id_col, seed=seed) < upto, F.lit(name)).otherwise(out) if upto > 0 else out
        upto -= share
    return df.withColumn("split", out)


def keep_positives(df: DataFrame, label: str, rate: float, *ids: str, seed: int = 0, by: Column | None = None) -> DataFrame:
    """All rows of label 1, and a share of the others, dealt by a hash of the ids or by a number in [0, 1) of the caller's."""
    return df.where((F.col(label) == 1) | ((lot(*ids, seed=seed) if by is None else by) < rate))


def prune(pairs: DataFrame, floor: float = 0.02, keep: int = 8, prob: str = "prob") -> DataFrame:
    """Pairs of at least ``floor``, the best ``keep`` of each query and source."""
    w = Window.partitionBy("country", "src", "s1_id").orderBy(F.desc(prob), "rec_id")
    return pairs.where(F.col(prob) >= floor).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def gate(pairs: DataFrame, low: float = 0.03, high: float = 0.97, prob: str = "prob") -> DataFrame:
    """Pairs that are worth an expensive judge."""
    return pairs.where(F.col(prob).between(low, high))


def folds(df: DataFrame, *ids: str) -> DataFrame:
    """``df`` with fold (2) and sub (10) from a hash of the ids."""
    h = F.pmod(F.xxhash64(*ids), F.lit(20))
    return df.withColumn("fold", (h % 2).cast("int")).withColumn("sub", F.floor(h / 2).cast("int"))


def capped(df: DataFrame, rows: int, *ids: str, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows for a model fit, the first of a fixed order."""
    return df.orderBy(F.xxhash64(*ids, F.lit(seed)), *ids).limit(rows)


def inspection(df: DataFrame, by: str, order: str, n: int = 300) -> DataFrame:
    """The first ``n`` rows of each value of ``by``; a report."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def mini(s1: DataFrame, pool: DataFrame, truth: DataFrame, per_country: int = 1000, decoys: int = 30_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A small data set: ``per_country`` S1 rows of each country, all their records, and up to ``decoys`` other records of each source."""
    w = Window.partitionBy("country").orderBy(F.xxhash64("s1_id", F.lit(seed)), "s1_id")
    few = s1.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_country).drop("__n")
    need = truth.join(few.select("s1_id"), "s1_id", "left_semi").select("rec_id").distinct()
    rest = pool.join(need, "rec_id", "left_anti")
    d = Window.partitionBy("src").orderBy(F.xxhash64("rec_id", F.lit(seed)), "rec_id")
    rest = rest.withColumn("__n", F.row_number().over(d)).where(F.col("__n") <= decoys).drop("__n")
    return few, pool.join(need, "rec_id", "left_semi").unionByName(rest)
