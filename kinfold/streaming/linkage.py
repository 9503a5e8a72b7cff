"""Beyond the batch engine: new pool records linked as they arrive.

Each micro-batch is normalised and joined to the S1 key table by exact name
key and by address key; the best query of each record goes to the sink. The S1
side is static, so no state is kept; of S1 rows with equal texts only the one
of the smallest id can be the best, so a key holds each text once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions.normalize import normalize
from kinfold.functions.similarity import words
from kinfold.operators.decide import one_owner
from kinfold.operators.sibling import address_key


def keyed(df: DataFrame) -> DataFrame:
    """Normalised rows, one for each blocking key (name key, address key)."""
    n = normalize(df).withColumn("addr_key", address_key(F.col("addr_norm")))
    keys = F.array(F.concat(F.lit("n:"), "name_key"), F.concat(F.lit("a:"), "addr_key"))
    return n.withColumn("key", F.explode(F.filter(keys, lambda k: F.length(k) > 2)))


def s1_keys(s1: DataFrame) -> DataFrame:
    """country, key, a_n, a_a (both texts) and the smallest s1_id of each."""
    return keyed(s1).groupBy("country", "key", F.col("name_core").alias("a_n"), F.col("addr_norm").alias("a_a")).agg(F.min("entity_id").alias("s1_id"))


def link_batch(batch: DataFrame, s1: DataFrame, threshold: float = 0.5) -> DataFrame:
    """country, src, rec_id, s1_id, prob of the records of a batch that reach ``threshold``. ``s1``: the result of ``s1_keys``."""
    pairs = keyed(batch).join(s1, ["country", "key"])

    def jaccard(a, b):
        u, v = words(F.col(a)), words(F.col(b))
        return F.when((F.size(u) == 0) | (F.size(v) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v)))

    prob = F.round(0.5 * jaccard("a_n", "name_core") + 0.5 * jaccard("a_a", "addr_norm"), 6)
    scored = pairs.select("country", "src", F.col("entity_id").alias("rec_id"), "s1_id", prob.alias("prob")).distinct().where(F.col("prob") >= threshold)
    return one_owner(scored)


def link_stream(records: DataFrame, s1: DataFrame, sink: str, checkpoint: str, threshold: float = 0.5, trigger: dict | None = None) -> StreamingQuery:
    """Link a stream of records (entity_id, src, country, business_name, business_address); a folder of Parquet per micro-batch, so that a repeated batch replaces itself."""
    # a table instead of a cache: it outlives lost executors, and goes with the checkpoint
    s1_keys(s1).write.mode("overwrite").parquet(f"{checkpoint}/s1-keys")
    keys = s1.sparkSession.read.parquet(f"{checkpoint}/s1-keys")

    def write(batch: DataFrame, number: int) -> None:
        link_batch(batch, keys, threshold).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
