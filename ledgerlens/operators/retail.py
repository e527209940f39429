"""Operations operators re-aimed from the dashboards' simulations onto real columns.

Where the reference draws random delivery times, random stock, fixed defect rates, a x0.88
"last week" and a hard-coded retention matrix, these compute the same views from data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import change_label, qcol
from ._common import dsum, one_row
from .quantiles import exact_quantiles
from .stats import histogram

# On-time status bands (% delivered within promise + grace).
SLA_BANDS = [(95.0, "EXCELLENT"), (85.0, "NEEDS ATTENTION")]
SLA_BELOW = "CRITICAL"


def sla_stats(df: DataFrame, duration: str, promise: float = 10.0, grace: float = 2.0) -> DataFrame:
    """On-time % (duration <= promise + grace), mean, exact P50 / P90 and the status band."""
    v = qcol(duration).cast("double")
    base = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    m = base.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("avg"),
                 (F.avg((F.col("v") <= promise + grace).cast("double")) * 100.0).alias("on_time_pct"))
    q = exact_quantiles(base, ["v"], [0.5, 0.9]).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("p") == 0.9, F.col("value"))).alias("p90"))
    out = m.crossJoin(one_row(q))
    status = reduce(lambda acc, b: acc.when(F.col("on_time_pct") >= b[0], b[1]),
                    SLA_BANDS[1:], F.when(F.col("on_time_pct") >= SLA_BANDS[0][0], SLA_BANDS[0][1]))
    return out.withColumn("status", status.otherwise(SLA_BELOW)).withColumn("promise", F.lit(float(promise)))


def sla_histogram(df: DataFrame, duration: str, bins: int = 12) -> DataFrame:
    """J01 distribution: 12 equal-width bins with centers."""
    h = histogram(df, duration, bins)
    return h.withColumn("center", (F.col("bin_start") + F.col("bin_end")) / 2)


# Days-of-cover risk bands and the velocity-to-daily-sales factor.
DAILY_SALES_FACTOR = 0.3


def days_of_cover(df: DataFrame, stock: DataFrame, product: str = "product", orders: str = "orders",
                  top: int | None = 10) -> DataFrame:
    """velocity = total orders per product (top ``top`` by velocity), daily sales =
    max(1, floor(0.3 x velocity)), days of cover = stock / daily sales (1 dp) joined from a real
    stock table (product, stock); < 1 CRITICAL, < 2 LOW, else OK."""
    vel = df.filter(qcol(product).isNotNull()).groupBy(product).agg(F.sum(orders).cast("long").alias("velocity"))
    if top:
        vel = vel.orderBy(F.col("velocity").desc(), qcol(product)).limit(top)
    j = vel.join(stock.select(F.col(stock.columns[0]).alias(product), F.col(stock.columns[1]).alias("stock_left")),
                 product, "left")
    daily = F.greatest(F.lit(1), F.floor(F.col("velocity") * DAILY_SALES_FACTOR).cast("long"))
    cover = F.bround(F.col("stock_left") / daily, 1)
    risk = F.when(cover < 1, "CRITICAL").when(cover < 2, "LOW").otherwise("OK")
    action = F.when(cover < 1, "ORDER NOW").when(cover < 2, "Plan Reorder").otherwise("Sufficient")
    return j.select(product, "velocity", "stock_left", daily.alias("daily_sales"), cover.alias("days_cover"),
                    F.when(F.col("stock_left").isNotNull(), risk).alias("risk"),
                    F.when(F.col("stock_left").isNotNull(), action).alias("action"))


def defect_funnel(df: DataFrame, status: str, defect_order: list[str]) -> DataFrame:
    """Total orders, then the remaining count after removing each defect status in the
    given order, the perfect-order count and the defect rate (from real status values)."""
    counts = df.groupBy(qcol(status).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("s") == d, F.col("n"))), F.lit(0))
                                                  .alias(f"_d{i}") for i, d in enumerate(defect_order)])
    steps = [F.struct(F.lit(0).alias("step"), F.lit("Total Orders").alias("label"), F.col("total").alias("remaining"),
                      F.lit(0).cast("long").alias("removed"))]
    running = F.col("total")
    for i, d in enumerate(defect_order):
        running = running - F.col(f"_d{i}")
        steps.append(F.struct(F.lit(i + 1).alias("step"), F.lit(f"After {d}").alias("label"), running.alias("remaining"),
                              F.col(f"_d{i}").cast("long").alias("removed")))
    defects = sum((F.col(f"_d{i}") for i in range(len(defect_order))), F.lit(0))
    out = one.select(F.explode(F.array(*steps)).alias("x"), F.col("total"), defects.alias("total_defects"))
    return out.select("x.*", "total", "total_defects",
                      F.when(F.col("total") > 0, F.col("total_defects") * 100.0 / F.col("total")).otherwise(0.0)
                      .alias("defect_rate_pct"))


def week_over_week(df: DataFrame, date: str, measures: dict[str, str]) -> DataFrame:
    """Per calendar week the measures (sum) and the change vs the previous present week,
    with the arrow label (K05). Weekly series are calendar-bounded."""
    wk = df.withColumn("_w", F.date_trunc("week", qcol(date))).filter(F.col("_w").isNotNull())
    g = wk.groupBy("_w").agg(*[dsum(c).alias(n) for n, c in measures.items()])
    w = Window.orderBy("_w")
    cols = [F.col("_w").alias("week")]
    for n in measures:
        prev = F.lag(n).over(w)
        cols += [F.col(n), prev.alias(f"{n}_prev"),
                 F.when(prev.isNotNull() & (prev != 0), (F.col(n) - prev) / F.abs(prev) * 100.0).alias(f"{n}_change_pct"),
                 F.when(prev.isNotNull(), change_label(F.col(n), prev)).alias(f"{n}_label")]
    return g.select(*cols).orderBy("week")


def _first_period(df: DataFrame, customer: str, date: str, grain: str) -> DataFrame:
    p = df.select(qcol(customer).alias("cust"), F.date_trunc(grain, qcol(date)).alias("period")) \
        .filter(F.col("cust").isNotNull() & F.col("period").isNotNull()).distinct()
    first = p.groupBy("cust").agg(F.min("period").alias("cohort"))
    return p.join(first, "cust")


def new_vs_repeat(df: DataFrame, customer: str, date: str, grain: str = "week") -> DataFrame:
    """Per period, distinct customers seen for the first time vs returning ones."""
    p = _first_period(df, customer, date, grain)
    return p.groupBy("period").agg(F.count(F.when(F.col("period") == F.col("cohort"), 1)).alias("new_customers"),
                                   F.count(F.when(F.col("period") > F.col("cohort"), 1)).alias("repeat_customers")) \
        .orderBy("period")


def cohort_retention(df: DataFrame, customer: str, date: str, grain: str = "month",
                     max_offset: int | None = None) -> DataFrame:
    """cohort = first period of a customer; per (cohort, offset) the active customers and
    the retention % of the cohort size (long form; offsets in periods of ``grain``)."""
    p = _first_period(df, customer, date, grain)
    if grain == "month":
        off = F.months_between("period", "cohort").cast("int")
    elif grain == "week":
        off = (F.datediff("period", "cohort") / 7).cast("int")
    else:
        off = F.datediff("period", "cohort")
    p = p.withColumn("offset", off)
    if max_offset is not None:
        p = p.filter(F.col("offset") <= max_offset)
    g = p.groupBy("cohort", "offset").agg(F.count(F.lit(1)).alias("customers"))
    size = g.filter(F.col("offset") == 0).select("cohort", F.col("customers").alias("cohort_size"))
    return g.join(size, "cohort").withColumn("retention_pct", F.col("customers") * 100.0 / F.col("cohort_size")) \
        .orderBy("cohort", "offset")


def optional_column_distributions(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """20-bin histograms of whichever of the optional numeric columns exist, one job:
    the columns are unpivoted and binned together against their own min/max."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, bin int, bin_start double, bin_end double, count long")
    parts = [F.struct(F.lit(c).alias("k"), qcol(c).cast("double").alias("v")) for c in present]
    long = df.select(F.explode(F.array(*parts)).alias("s")).select("s.k", "s.v") \
        .filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rng = long.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = long.join(F.broadcast(rng), "k")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width).cast("int"), F.lit(bins - 1)))
    counts = j.groupBy("k", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = rng.select("k", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = spine.join(counts, ["k", "bin"], "left").na.fill(0, ["count"])
    w = (F.col("hi") - F.col("lo")) / bins
    return out.select(F.col("k").alias("column"), "bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                      F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * w)
                      .alias("bin_end"), F.col("count").cast("long").alias("count")).orderBy("column", "bin")
