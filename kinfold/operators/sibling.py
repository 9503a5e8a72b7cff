"""Sibling groups: records of one source at the same address, whatever the order of its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.operators.compete import runner_up

LEAST, MOST = 2, 12


def address_key(addr: Column) -> Column:
    """Sorted distinct words of a normalised address."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(addr, " "), lambda w: w != ""))), " ")


def groups(pool: DataFrame, addr: str = "addr_norm", least: int = LEAST, most: int = MOST) -> DataFrame:
    """country, src, rec_id, group_key, group_size of the records whose address group has ``least`` to ``most`` members.

    Sizes are aggregated first, so an address with very many records is never
    gathered.
    """
    keyed = pool.select("country", "src", "rec_id", address_key(F.col(addr)).alias("group_key")).where("group_key <> ''")
    block = ["country", "src", "group_key"]
    sizes = keyed.groupBy(*block).agg(F.count("*").alias("group_size")).where(F.col("group_size").between(least, most))
    return keyed.join(sizes, block).select("country", "src", "rec_id", "group_key", "group_size")


def expand(pairs: DataFrame, members: DataFrame, prob: str = "prob", threshold: float = 0.9, per_s1: int = 4) -> DataFrame:
    """New pairs: group mates of a query's confident records that aren't its candidates yet, at most ``per_s1`` a query, smallest ids first."""
    block = ["country", "src"]
    strong = pairs.where(F.col(prob) >= threshold).join(members.select(*block, "rec_id", "group_key"), [*block, "rec_id"])
    wanted = strong.select(*block, "s1_id", "group_key").distinct()
    new = wanted.join(members.select(*block, "group_key", "rec_id"), [*block, "group_key"]).select(*block, "s1_id", "rec_id").distinct()
    new = new.join(pairs.select(*block, "s1_id", "rec_id"), [*block, "s1_id", "rec_id"], "left_anti")
    w = Window.partitionBy("country", "s1_id").orderBy("rec_id")
    return new.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_s1).drop("__n")


def leave_one_out(pairs: DataFrame, members: DataFrame, prob: str = "prob") -> DataFrame:
    """``pairs`` with sib_cnt, sib_mean and sib_max: what the other members of a record's group scored for the same query (0 without)."""
    own = pairs.join(members.select("country", "src", "rec_id", "group_key"), ["country", "src", "rec_id"], "left")
    w = Window.partitionBy("country", "src", "s1_id", "group_key")
    grouped = F.col("group_key").isNotNull()
    n, p = F.count("*").over(w), F.col(prob)
    return own.select(
        *pairs.columns,
        F.when(grouped, n - 1).otherwise(F.lit(0)).cast("long").alias("sib_cnt"),
        F.when(grouped & (n > 1), F.round((F.sum(p).over(w) - p) / (n - 1), 6)).otherwise(F.lit(0.0)).alias("sib_mean"),
        F.when(grouped, runner_up(p, w, "rec_id")).otherwise(F.lit(0.0)).alias("sib_max"),
    )
