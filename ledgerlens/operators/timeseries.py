"""Time-intelligence operators (H02-H16; H01 lives in ``functions.expr.parse_dates``).

Row-level work (parsing, truncation, grouping) is distributed over the whole table. The
results are period series whose length is bounded by the calendar span (months, days), not by
the data volume, so the windows over them (lag, growth) are cheap by construction. Regressions
use the ``regr_*`` aggregates (partial aggregation, one shuffle of one row per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import parse_dates, pct_change, qcol, safe_div
from ._common import dsum, one_row, positions

# Minimum history (in months) before each analysis is offered.
MIN_MONTHS_FOR_YOY = 13
MIN_MONTHS_FOR_SEASONALITY = 24
MIN_MONTHS_FOR_FORECAST = 6
# Measure concept -> monthly aggregation.
AGG_BY_CONCEPT = {"revenue": "sum", "cost": "sum", "profit": "sum", "quantity": "sum",
                  "price": "mean", "discount": "mean", "salary": "mean"}
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _dates(df: DataFrame, date: str, name: str = "_dt") -> DataFrame:
    dt = parse_dates(qcol(date), df.schema[date].dataType)
    return df.withColumn(name, dt).filter(F.col(name).isNotNull())


def agg_for(concept: str | None, confidence: float = 1.0) -> str:
    """Sum for revenue/cost/profit/quantity, mean for price/discount/salary, sum when the
    measure is unmapped or mapped below 0.6 confidence."""
    if concept is None or confidence < 0.6:
        return "sum"
    return AGG_BY_CONCEPT.get(concept, "sum")


def _agg_expr(col: str, how: str) -> Column:
    if how == "mean":
        return F.avg(qcol(col).cast("double"))
    return F.sum(qcol(col)).cast("double")


def date_range(df: DataFrame, date: str) -> DataFrame:
    """First and last date, span in days (inclusive), distinct months and years, dated rows."""
    d = _dates(df, date)
    return d.agg(F.min("_dt").alias("start"), F.max("_dt").alias("end"),
                 (F.datediff(F.max("_dt"), F.min("_dt")) + 1).alias("span_days"),
                 F.countDistinct(F.date_trunc("month", "_dt")).alias("distinct_months"),
                 F.countDistinct(F.year("_dt")).alias("distinct_years"),
                 F.count(F.lit(1)).alias("total_records"))


def monthly_table(df: DataFrame, date: str, measures: dict[str, str]) -> DataFrame:
    """One row per calendar month with year, month number / name, quarter label, yyyy-MM
    and each measure aggregated as given (``sum`` / ``mean``), ascending."""
    d = _dates(df, date).withColumn("_m", F.date_trunc("month", "_dt"))
    g = d.groupBy("_m").agg(*[_agg_expr(c, how).alias(c) for c, how in measures.items()])
    return g.select(
        F.date_format("_m", "yyyy-MM").alias("year_month"), F.year("_m").alias("year"),
        F.month("_m").alias("month_number"), F.date_format("_m", "MMM").alias("month_name"),
        F.concat(F.lit("Q"), F.quarter("_m").cast("string")).alias("quarter"),
        *measures.keys()).orderBy("year", "month_number")


def _last_two(monthly: DataFrame, measure: str) -> DataFrame:
    top2 = monthly.orderBy(F.col("year").desc(), F.col("month_number").desc()).limit(2)
    key = F.struct("year", "month_number")
    return top2.agg(F.max_by("year_month", key).alias("current_period"),
                    F.min_by("year_month", key).alias("previous_period"),
                    F.max_by(measure, key).alias("current_value"),
                    F.min_by(measure, key).alias("previous_value"),
                    F.count(F.lit(1)).alias("_n"))


def mom_growth(monthly: DataFrame, measure: str) -> DataFrame:
    """Last present month vs the previous present month (gaps are not filled, T14);
    growth null when the previous value is 0 or null; empty when fewer than two months."""
    t = _last_two(monthly, measure).filter(F.col("_n") >= 2).drop("_n")
    return t.withColumn("growth_pct", pct_change(F.col("current_value"), F.col("previous_value")))


def yoy_growth(monthly: DataFrame, measure: str) -> DataFrame:
    """Last month vs the same month one year earlier (equality match), needs 13 months of
    history; empty when unavailable."""
    n = monthly.agg(F.count(F.lit(1)).alias("_n"))
    cur = monthly.orderBy(F.col("year").desc(), F.col("month_number").desc()).limit(1)
    prev = monthly.select(F.col("year").alias("_py"), F.col("month_number").alias("_pm"),
                          F.col("year_month").alias("previous_period"),
                          F.col(measure).alias("previous_value"))
    j = cur.crossJoin(one_row(n)).filter(F.col("_n") >= MIN_MONTHS_FOR_YOY).join(
        prev, (F.col("_py") == F.col("year") - 1) & (F.col("_pm") == F.col("month_number")))
    return j.select(F.col("year_month").alias("current_period"), "previous_period",
                    F.col(measure).alias("current_value"), "previous_value",
                    pct_change(F.col(measure), F.col("previous_value")).alias("growth_pct"))


def seasonality(monthly: DataFrame, measure: str) -> DataFrame:
    """Mean per calendar month vs the overall monthly mean, in % (needs 24 months)."""
    stats = monthly.agg(F.avg(measure).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    by = monthly.groupBy("month_number", "month_name").agg(F.avg(measure).alias("month_mean"))
    j = by.crossJoin(one_row(stats)).filter(F.col("_n") >= MIN_MONTHS_FOR_SEASONALITY)
    dev = F.when(F.col("_mean") != 0, (F.col("month_mean") - F.col("_mean")) / F.col("_mean") * 100.0) \
        .otherwise(F.lit(0.0))
    return j.select("month_number", "month_name", "month_mean", dev.alias("deviation_pct")) \
        .orderBy("month_number")


def _ols(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"),
                  F.stddev_pop(y).alias("_sy"), F.avg(y).alias("_my"))


def forecast_monthly(monthly: DataFrame, measure: str, periods: int = 3) -> DataFrame:
    """OLS of the measure on the month index 0..n-1 (needs 6 months), forecasts for the
    next ``periods`` calendar months clipped at 0. Rows: actual months and forecast months."""
    w = Window.orderBy("year", "month_number")
    idx = monthly.withColumn("_x", (F.row_number().over(w) - 1).cast("double")) \
        .withColumn("_y", F.col(measure).cast("double"))
    fit = _ols(idx, "_x", "_y")
    last = monthly.agg(F.max(F.make_date("year", "month_number", F.lit(1))).alias("_last"))
    gate = fit.crossJoin(one_row(last)).filter(F.col("n") >= MIN_MONTHS_FOR_FORECAST)
    actual = idx.crossJoin(one_row(gate)).select(
        "year_month", F.col("_y").alias("value"), F.lit("actual").alias("kind"), "r2")
    fut = gate.select(F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_k"), "slope",
                      "intercept", "n", "_last", "r2")
    fc = fut.select(F.date_format(F.add_months("_last", F.col("_k")), "yyyy-MM").alias("year_month"),
                    F.greatest(F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("_k")),
                               F.lit(0.0)).alias("value"),
                    F.lit("forecast").alias("kind"), "r2")
    return actual.unionByName(fc)


def category_by_month(df: DataFrame, date: str, dim: str, measure: str, how: str = "sum",
                      last: int = 12) -> DataFrame:
    """Dim x yyyy-MM pivot (missing cells 0) over the most recent ``last`` months."""
    d = _dates(df, date).filter(qcol(dim).isNotNull()).withColumn("_ym", F.date_format("_dt", "yyyy-MM"))
    months = [r[0] for r in d.select("_ym").distinct().orderBy(F.col("_ym").desc()).limit(last).collect()]
    months = sorted(months)
    p = d.filter(F.col("_ym").isin(months)).groupBy(dim).pivot("_ym", months).agg(_agg_expr(measure, how))
    return p.na.fill(0.0, subset=months)


# Period labels of the time table.
LEVEL_FORMATS = {"Day": ("day", "dd MMM yyyy"), "Month": ("month", "MMM yyyy"), "Year": ("year", "yyyy")}


def time_table(df: DataFrame, date: str, level: str = "Month", revenue: str = "revenue",
               profit: str = "profit", orders: str = "orders") -> DataFrame:
    """Revenue, profit, orders, AOV, margin % and revenue growth % per day / month / year.
    Growth after a period without revenue is null."""
    unit, fmt = LEVEL_FORMATS[level]
    d = _dates(df, date).withColumn("_p", F.date_trunc(unit, "_dt"))
    g = d.groupBy("_p").agg(dsum(revenue).alias("revenue"), dsum(profit).alias("profit"),
                            F.sum(orders).cast("long").alias("orders"))
    g = g.select(F.col("_p").alias("period"), F.date_format("_p", fmt).alias("period_label"),
                 "revenue", "profit", "orders",
                 F.when(F.col("orders") > 0, F.col("revenue") / F.col("orders")).otherwise(0.0).alias("aov"),
                 F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100.0).otherwise(0.0)
                 .alias("margin"))
    w = Window.orderBy("period")
    before = F.lag("revenue").over(w)
    return g.withColumn("growth_pct", (F.try_divide(F.col("revenue"), before) - 1) * 100.0).orderBy("period")


def time_extremes(tt: DataFrame) -> DataFrame:
    """Best and weakest revenue period, period with most orders, with highest margin, and
    the latest growth (first occurrence wins ties, like ``idxmax``)."""
    return tt.agg(
        F.min_by("period_label", F.struct(-F.col("revenue"), F.col("period"))).alias("best_period"),
        F.max("revenue").alias("best_revenue"),
        F.min_by("period_label", F.struct(F.col("revenue"), F.col("period"))).alias("weakest_period"),
        F.min("revenue").alias("weakest_revenue"),
        F.min_by("period_label", F.struct(-F.col("orders"), F.col("period"))).alias("max_orders_period"),
        F.max("orders").alias("max_orders"),
        F.min_by("period_label", F.struct(-F.col("margin"), F.col("period"))).alias("max_margin_period"),
        F.max("margin").alias("max_margin"),
        F.max_by("growth_pct", F.col("period")).alias("latest_growth_pct"),
        F.count(F.lit(1)).alias("periods"))


def split_periods(df: DataFrame, date: str, name: str = "period_half") -> DataFrame:
    """Flags each row 'current' (date >= midpoint of the observed range) or 'previous';
    when the split is not usable (< 4 dated rows, one distinct instant, < 2 rows on a side) every
    row is 'current' and nothing is 'previous' (the reference then has no previous period)."""
    dt = parse_dates(qcol(date), df.schema[date].dataType)
    x = df.withColumn("_dt", dt)
    r = x.agg(F.min("_dt").alias("_lo"), F.max("_dt").alias("_hi"), F.count("_dt").alias("_nv"))
    mid = F.timestamp_seconds((F.unix_timestamp(F.col("_lo").cast("timestamp")) +
                               F.unix_timestamp(F.col("_hi").cast("timestamp"))) / 2.0)
    r = r.withColumn("_mid", mid.cast(x.schema["_dt"].dataType))
    j = x.crossJoin(one_row(r))
    cur = F.col("_dt") >= F.col("_mid")
    prev = F.col("_dt") < F.col("_mid")
    sides = j.agg(F.count(F.when(cur, 1)).alias("_nc"), F.count(F.when(prev, 1)).alias("_np"))
    j = j.crossJoin(one_row(sides))
    ok = (F.col("_nv") >= 4) & (F.col("_lo") != F.col("_hi")) & (F.col("_nc") >= 2) & (F.col("_np") >= 2)
    flag = F.when(~ok, F.lit("current")).when(cur, "current").when(prev, "previous")
    return j.withColumn(name, flag).drop("_dt", "_lo", "_hi", "_nv", "_mid", "_nc", "_np")


def trend(df: DataFrame, date: str, revenue: str = "revenue") -> DataFrame:
    """Revenue per month when at least two months exist, else per day (label, value)."""
    d = _dates(df, date).filter(qcol(revenue).isNotNull())
    months = d.groupBy(F.date_trunc("month", "_dt").alias("_p")).agg(dsum(revenue).alias("value"))
    nm = months.agg(F.count(F.lit(1)).alias("_nm"))
    days = d.groupBy(F.date_trunc("day", "_dt").alias("_p")).agg(dsum(revenue).alias("value"))
    m = months.crossJoin(one_row(nm)).filter(F.col("_nm") >= 2).select(
        F.col("_p").alias("period"), F.date_format("_p", "yyyy-MM").alias("label"), "value",
        F.lit("month").alias("grain"))
    dd = days.crossJoin(one_row(nm)).filter(F.col("_nm") < 2).select(
        F.col("_p").alias("period"), F.date_format("_p", "yyyy-MM-dd").alias("label"), "value",
        F.lit("day").alias("grain"))
    return m.unionByName(dd).orderBy("period")


def trend_forecast(tr: DataFrame) -> DataFrame:
    """OLS on index 1..n (needs 4 points), horizon min(3, max(1, n // 4)), forecasts clipped
    at 0, ci = 1.96 x population std of the residuals (= sqrt(1 - R^2) x std(y) for OLS with an
    intercept; 0 when n <= 2)."""
    w = Window.orderBy("period")
    idx = tr.withColumn("_x", F.row_number().over(w).cast("double")).withColumn("_y", F.col("value").cast("double"))
    fit = _ols(idx, "_x", "_y").filter(F.col("n") >= 4)
    fit = fit.withColumn("horizon", F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("n") / 4).cast("int"))))
    fit = fit.withColumn("ci", F.when(F.col("n") > 2, 1.96 * F.sqrt(F.greatest(1 - F.coalesce("r2", F.lit(1.0)),
                                                                           F.lit(0.0))) * F.col("_sy")).otherwise(0.0))
    fut = fit.select(F.explode(F.sequence(F.lit(1), F.col("horizon"))).alias("step"), "slope", "intercept",
                     "n", "r2", "ci", "horizon")
    return fut.select(F.concat(F.lit("Period +"), F.col("step").cast("string")).alias("label"), "step",
                      F.greatest(F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step")), F.lit(0.0))
                      .alias("forecast"), "ci", "r2", "horizon", "n")


def rank_forecast(df: DataFrame, dim: str = "product", revenue: str = "revenue") -> DataFrame:
    """Groups sorted ascending by revenue, OLS of revenue on rank 1..n (needs 5 groups):
    next value (clipped at 0), growth vs the mean %, R^2, slope, intercept, confidence band.
    The rank is a proxy, not time (as in the reference)."""
    g = df.filter(qcol(dim).isNotNull()).groupBy(dim).agg(dsum(revenue).alias("value"))
    ranked = positions(g, [F.col("value").asc(), qcol(dim).asc()], name="_x")
    fit = _ols(ranked.withColumn("_x", F.col("_x").cast("double")), "_x", "value").filter(F.col("n") >= 5)
    nxt = F.col("intercept") + F.col("slope") * (F.col("n") + 1)
    return fit.select(
        F.greatest(nxt, F.lit(0.0)).alias("next_value"),
        safe_div((nxt - F.col("_my")) * 100.0, F.col("_my")).alias("growth_pct"),
        "r2", "slope", "intercept",
        (1.96 * F.sqrt(F.greatest(1 - F.coalesce("r2", F.lit(1.0)), F.lit(0.0))) * F.col("_sy")).alias("confidence_band"),
        "n")


def daily_trend(df: DataFrame, date: str, measure: str) -> DataFrame:
    """Sum of the measure per calendar day, ascending."""
    d = _dates(df, date).filter(qcol(measure).isNotNull())
    return d.groupBy(F.to_date("_dt").alias("day")).agg(F.sum(qcol(measure)).cast("double").alias(measure)) \
        .orderBy("day")


def period_label(month_start: Column) -> Column:
    return F.date_format(month_start, "yyyy-MM")


def half_group_sums(df: DataFrame, date: str, dim: str, metric: str) -> DataFrame:
    """Per ``dim`` value the metric summed over the current and the previous half (H12 rules) in
    two scans: the date range, then one grouped aggregation that also carries the per-side row
    counts (null keys included, dropped afterwards) from which the split's validity is decided.
    Unusable split -> current = all rows, previous = 0. Returns (dim, current, previous)."""
    from ..session import checkpointed
    x = df.withColumn("_dt", parse_dates(qcol(date), df.schema[date].dataType))
    r = x.agg(F.min("_dt").alias("_lo"), F.max("_dt").alias("_hi"), F.count("_dt").alias("_nv"))
    mid = F.timestamp_seconds((F.unix_timestamp(F.col("_lo").cast("timestamp")) +
                               F.unix_timestamp(F.col("_hi").cast("timestamp"))) / 2.0)
    r = r.withColumn("_mid", mid.cast(x.schema["_dt"].dataType))
    j = x.crossJoin(one_row(r))
    cur, prev = F.col("_dt") >= F.col("_mid"), F.col("_dt") < F.col("_mid")

    def side_sum(cond):
        return F.coalesce(F.sum(F.when(cond, qcol(metric)) if cond is not None else qcol(metric)), F.lit(0)).cast("double")
    g = checkpointed(j.groupBy(qcol(dim).alias("_k")).agg(
        side_sum(cur).alias("_cur"), side_sum(prev).alias("_prev"), side_sum(None).alias("_all"),
        F.count(F.when(cur, 1)).alias("_nc"), F.count(F.when(prev, 1)).alias("_np"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_nv").alias("_nv")))
    flags = g.agg(F.sum("_nc").alias("_tc"), F.sum("_np").alias("_tp"), F.first("_lo").alias("_flo"),
                  F.first("_hi").alias("_fhi"), F.first("_nv").alias("_fnv"))
    valid = ((F.col("_fnv") >= 4) & (F.col("_flo") != F.col("_fhi")) & (F.col("_tc") >= 2) & (F.col("_tp") >= 2))
    out = g.filter(F.col("_k").isNotNull()).crossJoin(one_row(flags))
    return out.select(F.col("_k").alias(dim), F.when(valid, F.col("_cur")).otherwise(F.col("_all")).alias("current"),
                      F.when(valid, F.col("_prev")).otherwise(F.lit(0.0)).alias("previous"))
