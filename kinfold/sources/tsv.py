"""Tab-separated inputs and outputs: all strings, no quoting, empty instead of null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("s1_id", "ids")])


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", quote="", header=True, enforceSchema=True, mode="PERMISSIVE").na.fill("")


def read_records(spark: SparkSession, path: str, src: int | None = None) -> DataFrame:
    """entity_id, business_name, business_address, country, and src if it is given."""
    df = _scan(spark, path, RECORD)
    return df if src is None else df.withColumn("src", F.lit(src).cast("long"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_id and its record ids as an array; an empty list is an empty array."""
    df = _scan(spark, path, TRUTH)
    return df.select("s1_id", F.filter(F.split("ids", ","), lambda x: x != "").alias("rec_ids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """s1_id, rec_id, and pos, the record's place in the list."""
    return truth.select("s1_id", F.posexplode("rec_ids").alias("pos", "rec_id")).select("s1_id", "rec_id", "pos")


def owners(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """``pool`` with owner: the S1 id that a record belongs to, empty for decoys."""
    own = truth_pairs(truth).select(F.col("rec_id").alias("entity_id"), F.col("s1_id").alias("owner"))
    return pool.join(own, "entity_id", "left").na.fill("", ["owner"])


def read_some(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The first ``rows`` records by id."""
    return read_records(spark, path).orderBy("entity_id").limit(rows)


def write_lists(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """An id and a comma-joined list a line. Part files are sorted ranges of ``order``; ``single`` makes one file."""
    if order:
        df = df.orderBy(order)
    if single:
        df = df.coalesce(1)
    if order and order not in ("s1_id",):
        df = df.drop(order)
    df.write.mode("overwrite").csv(path, sep="\t", quote="", header=True, emptyValue="", nullValue="")
