"""Competition: how a pair stands against the others of its record and of its query.

Each function adds columns by whole-partition windows. A window's partition is
one record's or one query's candidates, which blocking has bounded. Ids come
first in it: rows are sorted by the first bytes of the first column, which for
countries are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

STRONG, SURE = 0.5, 0.9


def runner_up(value: Column, by: WindowSpec, *tie: str) -> Column:
    """The largest value among the other rows of the window's partition, 0 without others."""
    order = by.orderBy(value.desc(), *tie)
    place = F.row_number().over(order)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.coalesce(F.nth_value(value, 2).over(whole), F.lit(0.0))
    return F.when(place == 1, second).otherwise(F.first(value).over(whole))


def count_if(condition: Column, by: WindowSpec) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).over(by).cast("long")


def similarity(columns: list[str]) -> Column:
    """The sum of the views' scores."""
    return F.round(sum((F.col(c) for c in columns), F.lit(0.0)), 6)


def retrieval(pairs: DataFrame, sim: str = "sim") -> DataFrame:
    """rec_best, rec_n, rec_margin (best: lead over the next; others: distance to the best), s1_rank, s1_best, s1_gap."""
    rec, s1 = Window.partitionBy("rec_id", "src", "country"), Window.partitionBy("s1_id", "src", "country")
    v = F.col(sim)
    first = F.row_number().over(rec.orderBy(v.desc(), "s1_id")) == 1
    return pairs.withColumns(
        {
            "rec_best": F.max(v).over(rec),
            "rec_n": F.count("*").over(rec),
            "rec_margin": F.round(F.when(first, v - runner_up(v, rec, "s1_id")).otherwise(v - F.max(v).over(rec)), 6),
            "s1_rank": F.row_number().over(s1.orderBy(v.desc(), "rec_id")).cast("long"),
            "s1_best": F.max(v).over(s1),
            "s1_gap": F.round(v - F.max(v).over(s1), 6),
        }
    )


def stage_two(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """p_* by query and source, pa_* by query, d_* by record: best, gap, sum, count of strong ones, rank and size."""
    p = F.col(prob)
    one, both, rec = Window.partitionBy("s1_id", "src", "country"), Window.partitionBy("s1_id", "country"), Window.partitionBy("rec_id", "src", "country")
    out = {"p_strong": (p >= STRONG).cast("long"), "p_rank": F.row_number().over(one.orderBy(p.desc(), "rec_id")).cast("long")}
    for name, w in (("p", one), ("pa", both), ("d", rec)):
        out[f"{name}_best"] = F.max(p).over(w)
        out[f"{name}_gap"] = F.round(p - F.max(p).over(w), 6)
        out[f"{name}_cnt"] = count_if(p >= STRONG, w)
        if name != "d":
            out[f"{name}_sum"] = F.round(F.sum(p).over(w), 6)
    out["d_n"] = F.count("*").over(rec)
    return pairs.withColumns(out)


def stage_two_short(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """The shorter variant: ranks and sums by query and source, counts above one half, and the record's lead."""
    p = F.col(prob)
    one, rec = Window.partitionBy("s1_id", "src", "country"), Window.partitionBy("rec_id", "src", "country")
    lead = F.row_number().over(rec.orderBy(p.desc(), "s1_id")) == 1
    return pairs.withColumns(
        {
            "s1_rank_p": F.row_number().over(one.orderBy(p.desc(), "rec_id")).cast("long"),
            "s1_best_p": F.max(p).over(one), "s1_sum_p": F.round(F.sum(p).over(one), 6), "s1_gap_p": F.round(p - F.max(p).over(one), 6),
            "s1_n_hi": count_if(p > STRONG, one), "rec_n_hi": count_if(p > STRONG, rec), "rec_best_p": F.max(p).over(rec),
            "rec_margin_p": F.round(F.when(lead, p - runner_up(p, rec, "s1_id")).otherwise(p - F.max(p).over(rec)), 6),
        }
    )


def other_source(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """oth_best and oth_cnt: the best probability and the number of strong candidates of the same query in the other source."""
    one, both = Window.partitionBy("s1_id", "src", "country"), Window.partitionBy("s1_id", "country")
    p = F.col(prob)
    best = [F.max(F.when(F.col("src") == s, p)).over(both) for s in (2, 3)]
    other = F.when(F.col("src") == 2, best[1]).otherwise(best[0])
    return pairs.withColumns({"oth_best": F.coalesce(other, F.lit(0.0)), "oth_cnt": count_if(p >= STRONG, both) - count_if(p >= STRONG, one)})


def across_sources(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """xs_* by query over both sources, r_* by record over all queries."""
    p = F.col(prob)
    s1, rec = Window.partitionBy("s1_id", "country"), Window.partitionBy("rec_id", "src", "country")
    best = [F.max(F.when(F.col("src") == s, p)).over(s1) for s in (2, 3)]
    return pairs.withColumns(
        {
            "xs_rank": F.row_number().over(s1.orderBy(p.desc(), "src", "rec_id")).cast("long"),
            "xs_n50": count_if(p >= STRONG, s1), "xs_n90": count_if(p >= SURE, s1), "xs_sum": F.round(F.sum(p).over(s1), 6),
            "xs_other": runner_up(p, s1, "src", "rec_id"),
            "xs_other_src": F.coalesce(F.when(F.col("src") == 2, best[1]).otherwise(best[0]), F.lit(0.0)),
            "r_other": runner_up(p, rec, "s1_id"), "r_n50": count_if(p >= STRONG, rec),
            "r_rank": F.row_number().over(rec.orderBy(p.desc(), "s1_id")).cast("long"),
        }
    )
