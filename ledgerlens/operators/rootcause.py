"""Root cause operators (I02-I04) and the dimension-ordering helper K13.

The drill-down is sequential by nature (each level narrows to the previous level's weakest
value). For additive aggregations it runs on a pre-aggregated cube: one shuffle over the raw
rows, checkpointed, then at most ``max_levels`` small aggregations over the cube.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from ..functions.expr import qcol
from ._common import one_row
from .quantiles import exact_quantiles

# Broad-to-narrow hierarchy hints.
HIERARCHY_ORDER_HINTS = ["state", "region", "city", "area", "pincode", "store", "dark store",
                         "category", "subcategory", "brand", "product", "sku"]
ADDITIVE = {"sum", "count"}


def order_dimensions(dims: list[str]) -> list[str]:
    """Stable sort by the first hierarchy hint contained in the lower-case name."""
    def rank(c):
        low = c.lower()
        return next((i for i, h in enumerate(HIERARCHY_ORDER_HINTS) if h in low), len(HIERARCHY_ORDER_HINTS))
    return sorted(dims, key=rank)


def _agg(metric: str, how: str):
    m = qcol(metric)
    return {"sum": F.sum(m).cast("double"), "mean": F.avg(m.cast("double")), "count": F.count(m).cast("double"),
            "min": F.min(m).cast("double"), "max": F.max(m).cast("double")}[how]


def group_agg(df: DataFrame, dim: str, metric: str, how: str, name: str = "v") -> DataFrame:
    """(dim, aggregate) per non-null group; medians are exact and distributed (no group's
    values are gathered in one task)."""
    base = df.filter(qcol(dim).isNotNull())
    if how == "median":
        q = exact_quantiles(base, [metric], [0.5], by=dim)
        return q.select(qcol(dim), F.col("value").alias(name))
    return base.groupBy(dim).agg(_agg(metric, how).alias(name))


def weakest_segment(df: DataFrame, dim: str, metric: str, how: str = "sum") -> DataFrame:
    """The group with the smallest aggregated metric (ties -> smallest key), its share of
    the total and the number of segments (one row)."""
    g = group_agg(df, dim, metric, how)
    return g.agg(F.min_by(qcol(dim), F.struct(F.col("v"), qcol(dim))).cast("string").alias("value"),
                 F.min("v").alias("metric_value"), F.sum("v").alias("_t"), F.count(F.lit(1)).alias("n_segments")) \
        .select(F.lit(dim).alias("dimension"), "value", "metric_value",
                F.when(F.col("_t") != 0, F.col("metric_value") / F.col("_t") * 100.0).otherwise(0.0)
                .alias("share_of_total"), "n_segments")


def drill_down(df: DataFrame, dims: list[str], metric: str, how: str = "sum", max_levels: int = 4) -> DataFrame:
    """Walk the dimensions broad-to-narrow (K13), at each level keep the weakest value of
    the level (levels with < 2 distinct values are skipped) and stop once fewer than 2 rows
    remain. Returns the evidence chain (level, dimension, value, metric_value, share_of_total,
    n_segments)."""
    spark = df.sparkSession
    ordered = order_dimensions([d for d in dims if d in df.columns])[:max_levels]
    if how in ADDITIVE:
        # keep the native sum type (exact for decimals) until the final value
        val = F.sum(qcol(metric)) if how == "sum" else F.count(qcol(metric))
        base = checkpointed(df.groupBy(*[qcol(d) for d in ordered]).agg(val.alias("_m"),
                                                                          F.count(F.lit(1)).alias("_rows")))
        rows_expr, level_agg = F.sum("_rows"), F.sum("_m").cast("double")
    else:
        base, rows_expr, level_agg = df, F.count(F.lit(1)), None
    chain, work = [], base
    for level, dim in enumerate(ordered, start=1):
        # one job per level: group values, group sizes, the weakest group and its row count
        if level_agg is not None:
            stats = work.filter(qcol(dim).isNotNull()).groupBy(dim).agg(level_agg.alias("v"), rows_expr.alias("r"))
        else:
            sizes = work.filter(qcol(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias("r"))
            stats = group_agg(work, dim, metric, how).join(sizes, dim)
        order = F.struct(F.col("v"), qcol(dim))
        s = stats.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("t"), F.min_by(qcol(dim), order).alias("k"),
                      F.min("v").alias("mv"), F.min_by("r", order).alias("kr")).first()
        if s["n"] < 2:  # fewer than two distinct values: nothing to tell apart at this level
            continue
        share = (s["mv"] / s["t"] * 100.0) if s["t"] else 0.0
        chain.append((level, dim, str(s["k"]), float(s["mv"]), float(share), int(s["n"])))
        work = work.filter(qcol(dim) == F.lit(s["k"]))
        if s["kr"] < 2:
            break
    return spark.createDataFrame(chain, "level int, dimension string, value string, metric_value double, "
                                        "share_of_total double, n_segments int")


def contributors(current: DataFrame, previous: DataFrame, dim: str, metric: str, how: str = "sum",
                 n: int = 5) -> DataFrame:
    """Per group current and previous aggregate (full outer join, missing -> 0), change,
    ordered by |change| (ties -> key), top n, with each change's % of the net change of ALL
    groups."""
    cur = group_agg(current, dim, metric, how, "current")
    prev = group_agg(previous, dim, metric, how, "previous")
    both = cur.join(prev, dim, "full").na.fill(0.0, ["current", "previous"]) \
        .withColumn("change", F.col("current") - F.col("previous"))
    net = both.agg(F.sum("change").alias("_net"))
    top = both.orderBy(F.abs("change").desc(), qcol(dim).asc()).limit(n)
    return top.crossJoin(one_row(net)).withColumn(
        "contribution_pct", F.when(F.col("_net") != 0, F.col("change") / F.col("_net") * 100.0).otherwise(0.0)) \
        .drop("_net")


def contributors_by_half(df: DataFrame, date: str, dim: str, metric: str, n: int = 5) -> DataFrame:
    """I04 with the halves of the date range (H12) as the two periods: conditional sums in one
    grouped pass after the date-range pass (``half_group_sums``)."""
    from .timeseries import half_group_sums
    g = half_group_sums(df, date, dim, metric).withColumn("change", F.col("current") - F.col("previous"))
    net = g.agg(F.sum("change").alias("_net"))
    top = g.orderBy(F.abs("change").desc(), qcol(dim).asc()).limit(n)
    return top.crossJoin(one_row(net)).withColumn(
        "contribution_pct", F.when(F.col("_net") != 0, F.col("change") / F.col("_net") * 100.0).otherwise(0.0)) \
        .drop("_net")
