"""Aliases of address words, mined from matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_COUNT, LEAST_SHARE = 50, 0.4
#: A parameter of ``greedy``: alias pairs that this last step looks at, on the driver; the most frequent ones.
PAIRS = 100_000


def leftovers(pairs: DataFrame, a: str = "s1_addr", b: str = "rec_addr") -> DataFrame:
    """left, right: the one or two alphabetic words that one address of a matched pair has and the other lacks."""
    rest = lambda x, y: F.filter(F.split(F.col(x), " "), lambda w: (w != "") & ~F.array_contains(F.split(F.col(y), " "), w))
    both = pairs.select(rest(a, b).alias("x"), rest(b, a).alias("y")).where(F.size("x").between(1, 2) & F.size("y").between(1, 2))
    text = both.select(F.array_join("x", " ").alias("left"), F.array_join("y", " ").alias("right"))
    return text.where(F.col("left").rlike("^[a-z ]+$") & F.col("right").rlike("^[a-z ]+$"))


def alias_pairs(rest: DataFrame, least_count: int = LEAST_COUNT, least_share: float = LEAST_SHARE) -> DataFrame:
    """src, dst, n: leftovers that stand for each other often enough, from the rarer to the commoner."""
    pair = rest.groupBy("left", "right").agg(F.count("*").alias("n"))
    side = rest.groupBy("left").agg(F.count("*").alias("n_left"))
    freq = rest.select(F.explode(F.array("left", "right")).alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    good = pair.join(side, "left").where((F.col("n") >= least_count) & (F.col("n") / F.col("n_left") >= least_share))
    good = good.join(freq.select(F.col("w").alias("left"), F.col("f").alias("fl")), "left").join(freq.select(F.col("w").alias("right"), F.col("f").alias("fr")), "right")
    rare = F.col("fl") <= F.col("fr")
    return good.select(F.when(rare, F.col("left")).otherwise(F.col("right")).alias("src"), F.when(rare, F.col("right")).otherwise(F.col("left")).alias("dst"), "n")


def greedy(pairs: DataFrame, most: int = PAIRS) -> dict[str, str]:
    """Aliases by falling count, none whose either side is already rewritten; on the driver, over at most ``most`` pairs."""
    out: dict[str, str] = {}
    for r in pairs.orderBy(F.desc("n"), "src", "dst").limit(most).collect():
        if r["src"] not in out and r["dst"] not in out:
            out[r["src"]] = r["dst"]
    return out


def first_match(truth: DataFrame) -> DataFrame:
    """The record of each query that comes first in its list (``pos``), or the smallest id where no order is given."""
    w = Window.partitionBy("s1_id").orderBy(*(["pos"] if "pos" in truth.columns else []), "rec_id")
    return truth.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
