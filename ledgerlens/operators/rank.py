"""Ranking and window operators.

Global positions and running totals over group-level results use the distributed
``positions`` helper; per-group top-k uses a partitioned ``row_number`` (Spark applies the
group limit before the shuffle); time-ordered windows run over period aggregates whose size is
bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import pct_change, safe_div
from ._common import dsum, nonnull, one_row, positions, ranked_desc
from .quantiles import exact_quantiles


def group_values(df: DataFrame, dim: str, measure: str, agg: str = "sum",
                 name: str = "value") -> DataFrame:
    fn = {"sum": lambda x: dsum(x), "mean": lambda x: F.avg(x),
          "count": lambda x: F.count(x)}[agg]
    return nonnull(df, dim).groupBy(dim).agg(fn(measure).alias(name))


def rank_with_share(df: DataFrame, dim: str, measure: str = "revenue") -> DataFrame:
    """per group value, 1-based position (value desc, key asc), share of total % and
    distance from the mean group value %."""
    g = group_values(df, dim, measure)
    ranked = positions(g, ranked_desc("value", dim))
    # totals from the numbered (checkpointed) groups: no second scan of the input
    tot = ranked.agg(F.sum("value").alias("_t"), F.avg("value").alias("_m"))
    return (ranked.crossJoin(one_row(tot))
            .withColumn("share_pct", safe_div(F.col("value") * 100.0, F.col("_t")))
            .withColumn("vs_avg_pct", safe_div((F.col("value") - F.col("_m")) * 100.0, F.col("_m")))
            .drop("_t", "_m"))


def leader_gap(df: DataFrame, dim: str, measure: str = "revenue") -> DataFrame:
    """best and worst group and (best - worst) / worst % (0 with one group or worst <= 0)."""
    g = group_values(df, dim, measure)
    best_key = F.struct(-F.col("value"), F.col(dim))
    out = g.agg(F.min_by(dim, best_key).alias("best"), F.max("value").alias("best_value"),
                # worst = last row of (value desc, key asc)
                F.max_by(dim, best_key).alias("worst"),
                F.min("value").alias("worst_value"), F.count(F.lit(1)).alias("groups"))
    gap = F.when((F.col("groups") > 1) & (F.col("worst_value") > 0),
                 (F.col("best_value") - F.col("worst_value")) / F.col("worst_value") * 100.0).otherwise(0.0)
    return out.withColumn("gap_pct", gap)


def pareto(df: DataFrame, dim: str, measure: str = "revenue", threshold: float = 80.0) -> DataFrame:
    """groups by value desc with cumulative % of the total; ``cutoff`` = number of groups
    needed to reach ``threshold`` % (the last group when never reached), the share of groups that
    is and the value they carry."""
    g = group_values(df, dim, measure)
    ranked = positions(g, ranked_desc("value", dim), running=("value",))
    tot = ranked.agg(F.sum("value").alias("_t"), F.count(F.lit(1)).alias("groups"))
    r = ranked.crossJoin(one_row(tot)).withColumn("cum_pct", safe_div(F.col("cum_value") * 100.0, F.col("_t")))
    cut = r.agg(F.min(F.when(F.col("cum_pct") >= threshold, F.col("position"))).alias("_c"),
                F.max("position").alias("_last"))
    cut = cut.select(F.coalesce("_c", "_last").alias("cutoff"))
    out = r.crossJoin(one_row(cut))
    head_value = out.agg(F.sum(F.when(F.col("position") <= F.col("cutoff"), F.col("value"))).alias("head_value"))
    return (out.crossJoin(one_row(head_value))
            .withColumn("in_head", F.col("position") <= F.col("cutoff"))
            .withColumn("groups_share_pct", F.col("cutoff") * 100.0 / F.col("groups"))
            .drop("_t"))


def runner_up_gap(df: DataFrame, dim: str, measure: str = "revenue") -> DataFrame:
    """leader value minus runner-up value (two-row TakeOrdered, then one aggregation)."""
    g = group_values(df, dim, measure)
    top2 = g.orderBy(*ranked_desc("value", dim)).limit(2)
    k = F.struct(-F.col("value"), F.col(dim))
    return top2.agg(F.min_by(dim, k).alias("top1"), F.max("value").alias("top1_value"),
                    F.max_by(dim, k).alias("top2"),
                    F.when(F.count(F.lit(1)) > 1, F.min("value")).alias("top2_value")) \
        .withColumn("gap", F.col("top1_value") - F.col("top2_value"))


def period_growth(series: DataFrame, order_col: str, value: str, name: str = "growth_pct") -> DataFrame:
    """percent change to the previous present row (first row null); period-level input."""
    w = Window.orderBy(order_col)
    return series.withColumn(name, pct_change(F.col(value), F.lag(value).over(w)))


def minmax_score(df: DataFrame, dim: str, metrics: dict[str, Column]) -> DataFrame:
    """per group metrics, each min-max scaled over groups (0.5 when constant), score = mean
    of the scaled metrics x 100, descending."""
    g = nonnull(df, dim).groupBy(dim).agg(*[e.alias(n) for n, e in metrics.items()])
    bounds = g.agg(*[x for n in metrics for x in (F.min(n).alias(f"_mn_{n}"), F.max(n).alias(f"_mx_{n}"))])
    j = g.crossJoin(one_row(bounds))
    scaled = []
    for n in metrics:
        rng = F.col(f"_mx_{n}") - F.col(f"_mn_{n}")
        s = F.when(rng > 0, (F.col(n) - F.col(f"_mn_{n}")) / rng).otherwise(F.lit(0.5))
        scaled.append(s.alias(f"{n}_scaled"))
    j = j.select(dim, *metrics.keys(), *scaled)
    score = sum((F.col(f"{n}_scaled") for n in metrics), F.lit(0.0)) / len(metrics) * 100.0
    return j.withColumn("score", score).orderBy(*ranked_desc("score", dim))


# Quadrant labels of the profitability matrix.
QUADRANTS = {(True, True): "Star", (True, False): "Volume Driver",
             (False, True): "Growth Opportunity", (False, False): "Review"}


def quadrant(df: DataFrame, dim: str = "product", revenue: str = "revenue",
             profit: str = "profit", orders: str = "orders") -> DataFrame:
    """per group revenue, profit, orders, weighted margin; median split (>= is high) of
    revenue and margin across groups (exact medians, distributed) into four quadrants; plus the
    quadrant's group count."""
    g = (nonnull(df, dim).groupBy(dim)
         .agg(dsum(revenue).alias("revenue"), dsum(profit).alias("profit"),
              F.sum(orders).cast("long").alias("orders")))
    g = g.withColumn("margin", F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100.0)
                     .otherwise(0.0))
    med = exact_quantiles(g, ["revenue", "margin"], [0.5]).agg(
        F.max(F.when(F.col("column") == "revenue", F.col("value"))).alias("median_revenue"),
        F.max(F.when(F.col("column") == "margin", F.col("value"))).alias("median_margin"))
    j = g.crossJoin(one_row(med))
    hr = F.col("revenue") >= F.col("median_revenue")
    hm = F.col("margin") >= F.col("median_margin")
    q = (F.when(hr & hm, QUADRANTS[(True, True)]).when(hr, QUADRANTS[(True, False)])
         .when(hm, QUADRANTS[(False, True)]).otherwise(QUADRANTS[(False, False)]))
    j = j.withColumn("quadrant", q)
    counts = j.groupBy("quadrant").agg(F.count(F.lit(1)).alias("quadrant_count"))
    return j.join(counts, "quadrant")


def top_per_group(df: DataFrame, group: str, dim: str, measure: str = "revenue", k: int = 1) -> DataFrame:
    """the k best ``dim`` values inside each ``group`` value (e.g. best category per city)."""
    g = nonnull(df, group, dim).groupBy(group, dim).agg(dsum(measure).alias("value"))
    w = Window.partitionBy(group).orderBy(F.col("value").desc(), F.col(dim).asc())
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

