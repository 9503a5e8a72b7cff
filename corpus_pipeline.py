"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces. ``run`` writes each
stage's result to the shared folder and reads it back, so a lost executor
costs no finished stage; ``common.release`` removes these tables.

For all stages: an empty table gives an empty table; texts of any length are
read whole; columns beyond doc_id, text, source and n_chars, whatever they are
called, come back as they were in rows that stay. What each makes of nulls,
ties and repeated rows is said below.

SQL can't express the classifier and the tokeniser, so there is no SQL for
the whole; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import packing, quality
from kinfold.llm.common import materialize
from kinfold.llm.decontaminate import remove_contaminated
from kinfold.llm.ngram_join import keep_one
from kinfold.llm.substring_dedup import remove_repeats
from kinfold.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts have the score of no text; equal texts share their fate; a null doc_id is like any other."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id (null last; ties by the text's MD5; of equal rows any one). Texts without words, null ones too, all stay; so do different documents that share a doc_id."""
    return keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller doc_id holds too (null is larger than all; rows that share a doc_id, repeated ones too, keep theirs). n_chars follows a text that changed; null texts stay null."""
    return remove_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim benchmark window. Null and wordless texts stay; repeated rows, equal ids and null ids are judged row by row."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in packed sequences. A null or empty text is the end token alone, a null source a source; repeated rows and rows that share a doc_id, null too, are packed each for itself."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
