"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join on the smaller graph of the step
before, written to the shared folder. No neighbour list is ever gathered, and
the aggregates are written before they are joined: a small one is broadcast,
and a node with very many links is a skewed key that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge other than the roots; root is the smallest node of the component."""
    graph = materialize(_tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    while not _stars(graph):
        graph = materialize(_small(_large(graph)), "edges")
    return graph.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(graph: DataFrame) -> bool:
    """Whether every node points to one node, which points nowhere."""
    nodes = graph.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(graph.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return nodes.groupBy("n").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").isEmpty()


def whole(found: DataFrame) -> DataFrame:
    """``found`` of ``components`` with the roots as nodes of their own."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    pair = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    return pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(graph: DataFrame) -> DataFrame:
    """Every larger neighbour of u points to the least of u and its neighbours."""
    both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _tidy(both.where("v > u").join(materialize(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(graph: DataFrame) -> DataFrame:
    """u and its smaller neighbours point to the least of these."""
    graph = materialize(graph, "stars")
    least = materialize(graph.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = graph.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _tidy(moved.unionByName(least.select("u", F.col("m").alias("v"))))
