"""Registered queries for the time operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import parse_dates
from ..operators import timeseries as H
from .catalog import register, rnd, table
from .sales_view import sales

_MONTHLY_SQL = """monthly AS (SELECT strftime(m, '%Y-%m') AS year_month, year(m) AS year, month(m) AS month_number,
       strftime(m, '%b') AS month_name, 'Q' || CAST(quarter(m) AS VARCHAR) AS quarter, revenue, current_price, discount
FROM (SELECT date_trunc('month', order_date) AS m, CAST(sum(revenue) AS DOUBLE) AS revenue,
             avg(current_price) AS current_price, avg(CAST(discount AS DOUBLE)) AS discount
      FROM sales WHERE order_date IS NOT NULL GROUP BY 1))"""
MEASURES = {"revenue": "sum", "current_price": "mean", "discount": "mean"}


def _monthly(spark, d):
    return H.monthly_table(sales(spark, d), "order_date", MEASURES)


@register("h01_parse_mixed_dates", """
WITH s AS (SELECT strftime(o_orderdate, '%m/%d/%Y') AS s, o_orderdate AS d FROM orders
           UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderdate FROM orders
           UNION ALL SELECT strftime(o_orderdate, '%d %b %Y'), o_orderdate FROM orders)
SELECT date_trunc('month', d) AS month, count(*) AS parsed FROM s GROUP BY 1
""", with_sales=False)
def h01_parse_mixed_dates(spark, d):
    o = table(spark, d, "orders")
    s = (o.select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("s"))
         .unionByName(o.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("s")))
         .unionByName(o.select(F.date_format("o_orderdate", "dd MMM yyyy").alias("s"))))
    p = s.select(parse_dates(F.col("s"), s.schema["s"].dataType).alias("dt"))
    return p.groupBy(F.date_trunc("month", "dt").cast("timestamp_ntz").alias("month")) \
        .agg(F.count(F.lit(1)).alias("parsed"))


@register("h02_date_range", """
SELECT min(order_date) AS start, max(order_date) AS "end", datediff('day', min(order_date), max(order_date)) + 1 AS span_days,
       count(DISTINCT date_trunc('month', order_date)) AS distinct_months, count(DISTINCT year(order_date)) AS distinct_years,
       count(*) AS total_records FROM sales WHERE order_date IS NOT NULL
""")
def h02_date_range(spark, d):
    out = H.date_range(sales(spark, d), "order_date")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"),
                      *[c for c in out.columns if c not in ("start", "end")])


@register("h04_monthly_table", f"""
WITH {_MONTHLY_SQL}
SELECT year_month, year, month_number, month_name, quarter, revenue, round(current_price, 6) AS current_price,
       round(discount, 6) AS discount FROM monthly
""")
def h04_monthly_table(spark, d):
    return rnd(_monthly(spark, d), "current_price", "discount")


@register("h05_mom_growth", f"""
WITH {_MONTHLY_SQL}, t AS (SELECT * FROM monthly ORDER BY year DESC, month_number DESC LIMIT 2)
SELECT max(year_month) AS current_period, min(year_month) AS previous_period,
       max_by(revenue, year_month) AS current_value, min_by(revenue, year_month) AS previous_value,
       CASE WHEN min_by(revenue, year_month) = 0 THEN NULL ELSE
         (max_by(revenue, year_month) - min_by(revenue, year_month)) / abs(min_by(revenue, year_month)) * 100.0 END AS growth_pct
FROM t HAVING count(*) >= 2
""")
def h05_mom_growth(spark, d):
    return H.mom_growth(_monthly(spark, d), "revenue")


@register("h06_yoy_growth", f"""
WITH {_MONTHLY_SQL}, c AS (SELECT * FROM monthly ORDER BY year DESC, month_number DESC LIMIT 1)
SELECT c.year_month AS current_period, p.year_month AS previous_period, c.revenue AS current_value,
       p.revenue AS previous_value,
       CASE WHEN p.revenue = 0 THEN NULL ELSE (c.revenue - p.revenue) / abs(p.revenue) * 100.0 END AS growth_pct
FROM c JOIN monthly p ON p.year = c.year - 1 AND p.month_number = c.month_number
WHERE (SELECT count(*) FROM monthly) >= 13
""")
def h06_yoy_growth(spark, d):
    return H.yoy_growth(_monthly(spark, d), "revenue")


@register("h07_seasonality", f"""
WITH {_MONTHLY_SQL}, s AS (SELECT avg(revenue) AS mean, count(*) AS n FROM monthly)
SELECT month_number, month_name, round(avg(revenue), 4) AS month_mean,
       round(CASE WHEN s.mean <> 0 THEN (avg(revenue) - s.mean) / s.mean * 100.0 ELSE 0.0 END, 6) AS deviation_pct
FROM monthly, s WHERE s.n >= 24 GROUP BY month_number, month_name, s.mean
""")
def h07_seasonality(spark, d):
    out = rnd(H.seasonality(_monthly(spark, d), "revenue"), "deviation_pct")
    return out.withColumn("month_mean", F.round("month_mean", 4))


@register("h08_forecast_monthly", f"""
WITH {_MONTHLY_SQL},
i AS (SELECT year_month, year, month_number, revenue AS y, CAST(row_number() OVER (ORDER BY year, month_number) - 1 AS DOUBLE) AS x FROM monthly),
f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n,
             max(make_date(year, month_number, 1)) AS last FROM i),
g AS (SELECT * FROM f WHERE n >= 6)
SELECT year_month, round(y, 2) AS value, 'actual' AS kind, round(r2, 6) AS r2 FROM i, g
UNION ALL
SELECT strftime(last + INTERVAL (k) MONTH, '%Y-%m'), round(greatest(intercept + slope * (n - 1 + k), 0.0), 2), 'forecast', round(r2, 6)
FROM g, (SELECT unnest(range(1, 4)) AS k)
""")
def h08_forecast_monthly(spark, d):
    out = H.forecast_monthly(_monthly(spark, d), "revenue", 3)
    return out.withColumn("value", F.round("value", 2)).withColumn("r2", F.round("r2", 6))


@register("h09_category_by_month", """
WITH s AS (SELECT category, strftime(order_date, '%Y-%m') AS ym, revenue FROM sales WHERE order_date IS NOT NULL AND category IS NOT NULL),
m AS (SELECT DISTINCT ym FROM s ORDER BY ym DESC LIMIT 12),
k AS (SELECT * FROM s WHERE ym IN (SELECT ym FROM m)),
cells AS (SELECT category, ym FROM (SELECT DISTINCT category FROM k), m)
SELECT c.category, c.ym AS year_month, CAST(coalesce(sum(k.revenue), 0) AS DOUBLE) AS revenue
FROM cells c LEFT JOIN k ON k.category = c.category AND k.ym = c.ym GROUP BY c.category, c.ym
""")
def h09_category_by_month(spark, d):
    wide = H.category_by_month(sales(spark, d), "order_date", "category", "revenue")
    return wide.unpivot("category", [f"`{c}`" for c in wide.columns if c != "category"], "year_month", "revenue")


def _tt_sql(unit: str, fmt: str) -> str:
    return f"""
WITH g AS (SELECT date_trunc('{unit}', order_date) AS period, CAST(sum(revenue) AS DOUBLE) AS revenue,
                  CAST(sum(profit) AS DOUBLE) AS profit, CAST(sum(orders) AS BIGINT) AS orders
           FROM sales WHERE order_date IS NOT NULL GROUP BY 1)
SELECT period, strftime(period, '{fmt}') AS period_label, revenue, profit, orders,
       CASE WHEN orders > 0 THEN revenue / orders ELSE 0.0 END AS aov,
       CASE WHEN revenue > 0 THEN profit / revenue * 100.0 ELSE 0.0 END AS margin,
       (revenue / lag(revenue) OVER (ORDER BY period) - 1) * 100.0 AS growth_pct
FROM g"""


@register("h10_time_table_month", _tt_sql("month", "%b %Y"))
def h10_time_table_month(spark, d):
    out = H.time_table(sales(spark, d), "order_date", "Month")
    return out.withColumn("period", F.col("period").cast("timestamp_ntz"))


@register("h10_time_table_year", _tt_sql("year", "%Y"))
def h10_time_table_year(spark, d):
    out = H.time_table(sales(spark, d), "order_date", "Year")
    return out.withColumn("period", F.col("period").cast("timestamp_ntz"))


@register("h11_time_extremes", f"""
WITH t AS ({_tt_sql("month", "%b %Y")})
SELECT arg_min(period_label, (-revenue, period)) AS best_period, max(revenue) AS best_revenue,
       arg_min(period_label, (revenue, period)) AS weakest_period, min(revenue) AS weakest_revenue,
       arg_min(period_label, (-orders, period)) AS max_orders_period, max(orders) AS max_orders,
       arg_min(period_label, (-margin, period)) AS max_margin_period, max(margin) AS max_margin,
       arg_max(growth_pct, period) AS latest_growth_pct, count(*) AS periods FROM t
""")
def h11_time_extremes(spark, d):
    return H.time_extremes(H.time_table(sales(spark, d), "order_date", "Month"))


@register("h12_split_periods", """
WITH r AS (SELECT min(order_date) AS lo, max(order_date) AS hi, count(order_date) AS nv FROM sales),
m AS (SELECT *, lo + (hi - lo) / 2 AS mid FROM r),
x AS (SELECT s.*, m.* FROM sales s, m),
c AS (SELECT count(CASE WHEN order_date >= mid THEN 1 END) AS nc, count(CASE WHEN order_date < mid THEN 1 END) AS np FROM x),
f AS (SELECT x.*, CASE WHEN NOT (nv >= 4 AND lo <> hi AND nc >= 2 AND np >= 2) THEN 'current'
                       WHEN order_date >= mid THEN 'current' WHEN order_date < mid THEN 'previous' END AS period_half FROM x, c)
SELECT period_half, count(*) AS rows, CAST(sum(revenue) AS DOUBLE) AS revenue FROM f GROUP BY period_half
""")
def h12_split_periods(spark, d):
    s = H.split_periods(sales(spark, d), "order_date")
    return s.groupBy("period_half").agg(F.count(F.lit(1)).alias("rows"), F.sum("revenue").cast("double").alias("revenue"))


@register("h13_trend", """
WITH m AS (SELECT date_trunc('month', order_date) AS period, CAST(sum(revenue) AS DOUBLE) AS value FROM sales
           WHERE order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1)
SELECT period, strftime(period, '%Y-%m') AS label, value, 'month' AS grain FROM m WHERE (SELECT count(*) FROM m) >= 2
""")
def h13_trend(spark, d):
    out = H.trend(sales(spark, d), "order_date")
    return out.withColumn("period", F.col("period").cast("timestamp_ntz"))


@register("h14_trend_forecast", """
WITH m AS (SELECT date_trunc('month', order_date) AS period, CAST(sum(revenue) AS DOUBLE) AS value FROM sales
           WHERE order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1),
i AS (SELECT CAST(row_number() OVER (ORDER BY period) AS DOUBLE) AS x, value AS y FROM m),
f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n,
             stddev_pop(y) AS sy FROM i),
g AS (SELECT *, least(3, greatest(1, CAST(floor(n / 4) AS INTEGER))) AS horizon,
             CASE WHEN n > 2 THEN 1.96 * sqrt(greatest(1 - coalesce(r2, 1.0), 0.0)) * sy ELSE 0.0 END AS ci FROM f WHERE n >= 4)
SELECT 'Period +' || CAST(step AS VARCHAR) AS label, step, round(greatest(intercept + slope * (n + step), 0.0), 2) AS forecast,
       round(ci, 2) AS ci, round(r2, 6) AS r2, horizon, n
FROM g, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS step) s WHERE s.step <= g.horizon
""")
def h14_trend_forecast(spark, d):
    out = H.trend_forecast(H.trend(sales(spark, d), "order_date"))
    return (out.withColumn("forecast", F.round("forecast", 2)).withColumn("ci", F.round("ci", 2))
            .withColumn("r2", F.round("r2", 6)))


@register("h15_rank_forecast", """
WITH g AS (SELECT product, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE product IS NOT NULL GROUP BY product),
i AS (SELECT CAST(row_number() OVER (ORDER BY value, product) AS DOUBLE) AS x, value AS y FROM g),
f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n,
             stddev_pop(y) AS sy, avg(y) AS my FROM i)
SELECT round(greatest(intercept + slope * (n + 1), 0.0), 2) AS next_value,
       round(CASE WHEN my = 0 THEN 0.0 ELSE (intercept + slope * (n + 1) - my) * 100.0 / my END, 6) AS growth_pct,
       round(r2, 6) AS r2, round(slope, 4) AS slope, round(intercept, 2) AS intercept,
       round(1.96 * sqrt(greatest(1 - coalesce(r2, 1.0), 0.0)) * sy, 2) AS confidence_band, n
FROM f WHERE n >= 5
""")
def h15_rank_forecast(spark, d):
    out = H.rank_forecast(sales(spark, d), "product")
    return out.select(F.round("next_value", 2).alias("next_value"), F.round("growth_pct", 6).alias("growth_pct"),
                      F.round("r2", 6).alias("r2"), F.round("slope", 4).alias("slope"),
                      F.round("intercept", 2).alias("intercept"),
                      F.round("confidence_band", 2).alias("confidence_band"), "n")


@register("h16_daily_trend_ship", """
SELECT CAST(ship_date AS DATE) AS day, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales
WHERE ship_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1
""")
def h16_daily_trend_ship(spark, d):
    return H.daily_trend(sales(spark, d), "ship_date", "revenue")
