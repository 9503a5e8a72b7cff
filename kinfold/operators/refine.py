"""Evidence beyond the pair: rarity, token weights, and the query's other confident records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.functions.similarity import words

CONFIDENT, MATES = 0.8, 8
EQUAL = 99.5


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.round(F.log(c / (1 - c)), 6)


def key_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """country, key and how many rows hold it."""
    return df.groupBy("country", key).agg(F.count("*").alias(name))


def with_count(pairs: DataFrame, counts: DataFrame, own: str, key: str, count: str, name: str) -> DataFrame:
    """``pairs`` with log1p of the count of its key ``own``."""
    c = counts.select("country", F.col(key).alias(own), F.col(count).alias("__c"))
    return pairs.join(c, ["country", own], "left").withColumn(name, F.round(F.log1p(F.coalesce("__c", F.lit(0))), 6)).drop("__c")


def rarity(pairs: DataFrame, s1_all: DataFrame, pool: DataFrame) -> DataFrame:
    """``pairs`` (with s1_key, rec_key, rec_addr) and log1p counts of its keys in the pool and in all of S1; k_addr_rec is -1 without an address."""
    pool_key, pool_addr, s1_key = key_counts(pool, "name_key", "n"), key_counts(pool.where("addr_norm <> ''"), "addr_norm", "n"), key_counts(s1_all, "name_key", "n")
    out = with_count(pairs, pool_key, "rec_key", "name_key", "n", "k_pool_rec")
    out = with_count(out, pool_key, "s1_key", "name_key", "n", "k_pool_s1")
    out = with_count(out, pool_addr, "rec_addr", "addr_norm", "n", "k_addr_rec")
    out = out.withColumn("k_addr_rec", F.when(F.col("rec_addr") == "", F.lit(-1.0)).otherwise(F.col("k_addr_rec")))
    out = with_count(out, s1_key, "rec_key", "name_key", "n", "k_s1a_rec")
    out = with_count(out, s1_key, "s1_key", "name_key", "n", "k_s1a_s1")
    count = F.expm1("k_s1a_rec") - (F.col("rec_key") == F.col("s1_key")).cast("int")
    return out.withColumn("k_s1a_rec_other", F.round(F.log1p(F.greatest(F.round(count), F.lit(0.0))), 6))


def token_idf(pool: DataFrame, column: str) -> DataFrame:
    """country, word, idf = ln((n + 1) / (df + 1)) + 1 over the pool's rows."""
    n = pool.groupBy("country").agg(F.count("*").alias("n"))
    df = pool.select("country", F.explode(words(F.col(column))).alias("word")).groupBy("country", "word").agg(F.count("*").alias("df"))
    return df.join(n, "country").select("country", "word", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted_jaccard(pairs: DataFrame, pool: DataFrame, column: str, s1_col: str, rec_col: str, name: str) -> DataFrame:
    """``pairs`` with ``name`` (idf-weighted Jaccard; -1 where a side is empty) and ``name_miss`` (weight of the query's words that the record lacks).

    Words that the pool doesn't hold weigh ln(n + 1) + 1.
    """
    ids = ["country", "src", "s1_id", "rec_id"]
    a, b = words(F.col(s1_col)), words(F.col(rec_col))
    long = pairs.select(*ids, a.alias("a"), b.alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    long = long.select(*ids, "a", "b", F.explode(F.array_union("a", "b")).alias("word"))
    long = long.select(*ids, "word", F.array_contains("a", F.col("word")).alias("in_a"), F.array_contains("b", F.col("word")).alias("in_b"))
    n = pool.groupBy("country").agg(F.count("*").alias("n"))
    w = F.coalesce("idf", F.log(F.col("n") + 1) + 1)
    long = long.join(token_idf(pool, column), ["country", "word"], "left").join(n, "country").withColumn("w", w)
    sums = long.groupBy(*ids).agg(
        F.round(F.sum(F.when(F.col("in_a") & F.col("in_b"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias(name),
        F.round(F.sum(F.when(F.col("in_a") & ~F.col("in_b"), F.col("w")).otherwise(0.0)), 6).alias(f"{name}_miss"),
    )
    out = pairs.join(sums, ids, "left")
    return out.fillna({name: -1.0, f"{name}_miss": 0.0})


def oov_share(df: DataFrame, vocab: DataFrame, ids: list[str], column: str, least: int = 3) -> DataFrame:
    """ids and the share of the column's words with a vocabulary count under ``least`` (0 without words)."""
    w = F.filter(F.split(F.col(column), " "), lambda x: x != "")
    long = df.select(*ids, F.explode(w).alias("word")).join(vocab, "word", "left")
    share = long.groupBy(*ids).agg(F.round(F.avg(F.when(F.coalesce("n", F.lit(0)) < least, 1.0).otherwise(0.0)), 6).alias("oov"))
    return df.select(*ids).join(share, ids, "left").fillna(0.0, ["oov"])


def confident(pairs: DataFrame, prob: str = "prob", threshold: float = CONFIDENT, most: int = MATES) -> DataFrame:
    """Each query's confident records of both sources, at most ``most``."""
    w = Window.partitionBy("country", "s1_id").orderBy(F.desc(prob), "src", "rec_id")
    return pairs.where(F.col(prob) >= threshold).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def mates(pairs: DataFrame, name_score, addr_score, prob: str = "prob", threshold: float = CONFIDENT, most: int = MATES) -> DataFrame:
    """Every pair against the query's other confident records: m_* aggregates, 0 without mates (m_ad_max -1).

    ``pairs`` has rec_name, rec_addr, rec_num (-1: none) and rec_legal;
    ``name_score`` and ``addr_score`` score two such columns from 0 to 100.
    """
    ids = ["country", "src", "s1_id", "rec_id"]
    some = confident(pairs, prob, threshold, most)
    m = some.select("country", "s1_id", *(F.col(c).alias(f"m_{c}") for c in ("src", "rec_id", "rec_name", "rec_addr", "rec_num", "rec_legal", prob)))
    x = pairs.join(m, ["country", "s1_id"]).where((F.col("src") != F.col("m_src")) | (F.col("rec_id") != F.col("m_rec_id")))
    x = x.withColumn("nm", name_score(F.col("rec_name"), F.col("m_rec_name")))
    x = x.withColumn("ad", F.when((F.col("rec_addr") != "") & (F.col("m_rec_addr") != ""), addr_score(F.col("rec_addr"), F.col("m_rec_addr"))).otherwise(F.lit(-1.0)))
    has_num, has_legal = (F.col("rec_num") >= 0) & (F.col("m_rec_num") >= 0), (F.col("rec_legal") != "") & (F.col("m_rec_legal") != "")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    same_num, same_legal = F.col("rec_num") == F.col("m_rec_num"), F.col("rec_legal") == F.col("m_rec_legal")
    found = x.groupBy(*ids).agg(
        F.count("*").alias("m_cnt"), F.round(F.max("nm"), 6).alias("m_nm_max"), F.round(F.avg("nm"), 6).alias("m_nm_mean"),
        F.round(F.max(F.col("nm") * F.col(f"m_{prob}")), 6).alias("m_nm_wmax"), F.max(F.when(F.col("nm") >= EQUAL, 1).otherwise(0)).cast("long").alias("m_nm_eq"),
        F.round(F.max("ad"), 6).alias("m_ad_max"), one(has_num).alias("m_num_has"), one(has_num & same_num).alias("m_num_agree"), one(has_num & ~same_num).alias("m_num_dis"),
        F.round(F.max(F.when(F.col("src") != F.col("m_src"), F.col("nm")).otherwise(0.0)), 6).alias("m_x_nm_max"), one(has_legal).alias("m_leg_has"), one(has_legal & same_legal).alias("m_leg_agree"),
    )
    return pairs.join(found, ids, "left").fillna({"m_ad_max": -1.0}).fillna(0, [c for c in found.columns if c.startswith("m_") and c != "m_ad_max"])


def consensus(pairs: DataFrame, s1_value: str, rec_value: str, missing, name: str, prob: str = "prob", threshold: float = CONFIDENT, most: int = MATES) -> DataFrame:
    """``pairs`` with whether the record agrees with the most frequent value of the query and its confident records (ties: the smallest); -1 where either is missing."""
    own = pairs.select("country", "s1_id", F.col(s1_value).alias("v")).distinct()
    theirs = confident(pairs, prob, threshold, most).select("country", "s1_id", F.col(rec_value).alias("v"))
    count = own.unionByName(theirs).where(F.col("v") != missing).groupBy("country", "s1_id", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("country", "s1_id").orderBy(F.desc("c"), "v")
    mode = count.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("country", "s1_id", F.col("v").alias("__mode"))
    out = pairs.join(mode, ["country", "s1_id"], "left")
    agree = F.when((F.col(rec_value) == missing) | F.col("__mode").isNull(), F.lit(-1)).otherwise((F.col(rec_value) == F.col("__mode")).cast("int"))
    return out.withColumn(name, agree.cast("long")).drop("__mode")
