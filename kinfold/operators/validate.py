"""Rules that result files must meet, each one count over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

S1_PREFIX, RECORD_PREFIX = "S1-", r"^S[23]-"
EXAMPLES = 5


def _rule(rows: DataFrame, name: str, example: str) -> DataFrame:
    """rule, n, examples (the first few by order; the operator is a report)."""
    few = F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("__k") <= EXAMPLES, F.col(example)))), 1, EXAMPLES), ",")
    from pyspark.sql.window import Window

    # examples come from a top-k by id: no list of all offenders is gathered
    top = rows.select(F.col(example).cast("string").alias(example)).distinct().orderBy(example).limit(EXAMPLES)
    top = top.withColumn("__k", F.row_number().over(Window.orderBy(example)))
    return rows.agg(F.count("*").alias("n")).crossJoin(top.agg(few.alias("examples"))).select(F.lit(name).alias("rule"), "n", "examples")


def validate(results: DataFrame, s1: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None, id_col: str = "s1_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """rule, n, examples: a row for every rule, n = 0 where it holds.

    ``results``: an id and a comma-joined list; ``s1``: the ids that must be
    there; ``known``: record ids (rec_id); ``candidates``: id and list that
    must contain the results (a warning).
    """
    lists = results.select(F.col(id_col).alias("s1_id"), F.filter(F.split(F.coalesce(F.col(list_col), F.lit("")), ","), lambda x: x != "").alias("ids"))
    flat = lists.select("s1_id", F.explode("ids").alias("rec_id"))
    twice = lists.groupBy("s1_id").count().where("count > 1")
    rules = [
        _rule(lists.where("s1_id is null or s1_id = ''"), "empty_id", "s1_id"),
        _rule(twice, "duplicate_row", "s1_id"),
        _rule(lists.where(F.size(F.array_distinct("ids")) < F.size("ids")), "repeated_id_in_list", "s1_id"),
        _rule(flat.where(F.col("rec_id").startswith(S1_PREFIX)), "self_match", "rec_id"),
        _rule(flat.where(~F.col("rec_id").rlike(RECORD_PREFIX) & ~F.col("rec_id").startswith(S1_PREFIX)), "wrong_prefix", "rec_id"),
        _rule(s1.select("s1_id").join(lists, "s1_id", "left_anti"), "missing_row", "s1_id"),
        _rule(lists.join(s1, "s1_id", "left_anti"), "unexpected_row", "s1_id"),
    ]
    if known is not None:
        rules.append(_rule(flat.join(known.select("rec_id"), "rec_id", "left_anti"), "unknown_id", "rec_id"))
    if candidates is not None:
        c = candidates.select(F.col(id_col).alias("s1_id"), F.explode(F.split(list_col, ",")).alias("rec_id"))
        rules.append(_rule(flat.join(c, ["s1_id", "rec_id"], "left_anti"), "match_not_a_candidate", "rec_id"))
    return reduce(DataFrame.unionByName, rules)


def file_rules(spark: SparkSession, path: str, header: tuple[str, str]) -> DataFrame:
    """rule, n, examples of a result file as text: its first line, comma-separated lines, and lines that aren't an id, a tab and a list.

    ``path`` may be a folder of parts, each with the header.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    first = "\t".join(header)
    rows = lines.where(F.col("line") != first)
    tabs = F.size(F.split("line", "\t")) - 1
    comma = (tabs == 0) & F.col("line").contains(",")
    wrong_header = lines.agg(F.sum((F.col("line") == first).cast("int")).alias("k")).where("coalesce(k, 0) = 0").select(F.lit(first).alias("line"))
    rules = [
        _rule(wrong_header, "missing_header", "line"),
        _rule(rows.where(comma), "comma_separated", "line"),
        _rule(rows.where((tabs != 1) & ~comma), "malformed_row", "line"),
        _rule(rows.where((tabs == 1) & F.col("line").rlike(r"\t.*(,,|^,|,$| |\")")), "malformed_list", "line"),
    ]
    return reduce(DataFrame.unionByName, rules)


def passes(report: DataFrame, warnings: tuple[str, ...] = ("match_not_a_candidate",)) -> bool:
    """Whether all rules hold but for warnings."""
    return report.where((F.col("n") > 0) & ~F.col("rule").isin(*warnings)).isEmpty()
