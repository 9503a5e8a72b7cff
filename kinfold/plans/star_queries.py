"""Plain relational queries over the star tables: every kind of join, aggregate, window and set operation the engine leans on."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.plans.queries import query
from kinfold.sources.tables import table


@query(
    """SELECT n_name, l_returnflag, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL"""
)
def star_revenue(spark, sf):
    li, s, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    j = li.where("l_shipdate >= timestamp'1995-01-01'").join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    return j.groupBy("n_name", "l_returnflag").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 2")
def star_top_orders(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 2")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def star_no_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(a.k, b.k) AS nationkey, coalesce(na, 0) AS n_customers, coalesce(nb, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS na FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS nb FROM supplier GROUP BY 1) b ON a.k = b.k")
def star_full_join(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nationkey", "full").fillna(0)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) EXCEPT SELECT s_nationkey FROM supplier")
def star_set_difference(spark, sf):
    c = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("n_nationkey")
    return c.subtract(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, min(ts) AS first_ts FROM events GROUP BY event_type")
def star_events(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.min("ts").alias("first_ts"))
