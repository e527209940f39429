"""Registered queries for ranking and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as R
from .catalog import register, rnd
from .sales_view import sales


@register("f01_rank_with_share_category", """
WITH g AS (SELECT category, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE category IS NOT NULL GROUP BY category)
SELECT category, value, row_number() OVER (ORDER BY value DESC, category) AS position,
       CASE WHEN sum(value) OVER () = 0 THEN 0.0 ELSE value * 100.0 / sum(value) OVER () END AS share_pct,
       round(CASE WHEN avg(value) OVER () = 0 THEN 0.0 ELSE (value - avg(value) OVER ()) * 100.0 / avg(value) OVER () END, 6) AS vs_avg_pct
FROM g
""")
def f01_rank_with_share_category(spark, d):
    return rnd(R.rank_with_share(sales(spark, d), "category"), "vs_avg_pct")


@register("f01_rank_with_share_product", """
WITH g AS (SELECT product, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE product IS NOT NULL GROUP BY product)
SELECT product, value, row_number() OVER (ORDER BY value DESC, product) AS position,
       CASE WHEN sum(value) OVER () = 0 THEN 0.0 ELSE value * 100.0 / sum(value) OVER () END AS share_pct,
       round(CASE WHEN avg(value) OVER () = 0 THEN 0.0 ELSE (value - avg(value) OVER ()) * 100.0 / avg(value) OVER () END, 6) AS vs_avg_pct
FROM g
""")
def f01_rank_with_share_product(spark, d):
    return rnd(R.rank_with_share(sales(spark, d), "product"), "vs_avg_pct", "share_pct")


@register("f02_leader_gap_city", """
WITH g AS (SELECT city, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE city IS NOT NULL GROUP BY city)
SELECT (SELECT city FROM g ORDER BY value DESC, city LIMIT 1) AS best, max(value) AS best_value,
       (SELECT city FROM g ORDER BY value ASC, city DESC LIMIT 1) AS worst, min(value) AS worst_value,
       count(*) AS groups,
       CASE WHEN count(*) > 1 AND min(value) > 0 THEN (max(value) - min(value)) / min(value) * 100.0 ELSE 0.0 END AS gap_pct
FROM g
""")
def f02_leader_gap_city(spark, d):
    return R.leader_gap(sales(spark, d), "city")


@register("f03_pareto_product", """
WITH g AS (SELECT product, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE product IS NOT NULL GROUP BY product),
r AS (SELECT product, value, row_number() OVER (ORDER BY value DESC, product) AS position,
             sum(value) OVER (ORDER BY value DESC, product ROWS UNBOUNDED PRECEDING) AS cum_value,
             sum(value) OVER () AS t, count(*) OVER () AS groups FROM g),
r2 AS (SELECT *, CASE WHEN t = 0 THEN 0.0 ELSE cum_value * 100.0 / t END AS cum_pct FROM r),
c AS (SELECT coalesce(min(CASE WHEN cum_pct >= 80 THEN position END), max(position)) AS cutoff FROM r2)
SELECT product, value, position, round(cum_value, 2) AS cum_value, groups, round(cum_pct, 6) AS cum_pct, c.cutoff,
       (SELECT round(sum(value), 2) FROM r2 WHERE position <= c.cutoff) AS head_value,
       position <= c.cutoff AS in_head, c.cutoff * 100.0 / groups AS groups_share_pct
FROM r2, c
""")
def f03_pareto_product(spark, d):
    out = R.pareto(sales(spark, d), "product")
    return out.select(*[F.round(c, 2).alias(c) if c in ("cum_value", "head_value") else
                        (F.round(c, 6).alias(c) if c == "cum_pct" else F.col(c)) for c in out.columns])


@register("f04_runner_up_gap_category", """
WITH g AS (SELECT category, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE category IS NOT NULL GROUP BY category
           ORDER BY value DESC, category LIMIT 2)
SELECT (SELECT category FROM g ORDER BY value DESC, category LIMIT 1) AS top1, max(value) AS top1_value,
       (SELECT category FROM g ORDER BY value ASC, category DESC LIMIT 1) AS top2,
       CASE WHEN count(*) > 1 THEN min(value) END AS top2_value,
       max(value) - CASE WHEN count(*) > 1 THEN min(value) END AS gap
FROM g
""")
def f04_runner_up_gap_category(spark, d):
    return R.runner_up_gap(sales(spark, d), "category")


@register("f05_period_growth_monthly", """
WITH m AS (SELECT date_trunc('month', order_date) AS month, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales
           WHERE order_date IS NOT NULL GROUP BY 1)
SELECT month, revenue,
       (revenue - lag(revenue) OVER (ORDER BY month)) / abs(lag(revenue) OVER (ORDER BY month)) * 100.0 AS growth_pct
FROM m
""")
def f05_period_growth_monthly(spark, d):
    s = sales(spark, d).filter(F.col("order_date").isNotNull())
    m = s.groupBy(F.date_trunc("month", "order_date").cast("timestamp_ntz").alias("month")) \
        .agg(F.sum("revenue").cast("double").alias("revenue"))
    return R.period_growth(m, "month", "revenue")


@register("f06_minmax_score_city", """
WITH g AS (SELECT city, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(orders) AS DOUBLE) AS orders,
                  round(avg(current_price), 9) AS avg_price, CAST(sum(discount) AS DOUBLE) / count(discount) AS avg_discount,
                  round(avg(margin_pct), 9) AS avg_margin
           FROM sales WHERE city IS NOT NULL GROUP BY city),
b AS (SELECT min(revenue) a1, max(revenue) b1, min(orders) a2, max(orders) b2, min(avg_price) a3, max(avg_price) b3,
             min(avg_discount) a4, max(avg_discount) b4, min(avg_margin) a5, max(avg_margin) b5 FROM g),
s AS (SELECT g.*,
   CASE WHEN b1 > a1 THEN (revenue - a1) / (b1 - a1) ELSE 0.5 END AS revenue_scaled,
   CASE WHEN b2 > a2 THEN (orders - a2) / (b2 - a2) ELSE 0.5 END AS orders_scaled,
   CASE WHEN b3 > a3 THEN (avg_price - a3) / (b3 - a3) ELSE 0.5 END AS avg_price_scaled,
   CASE WHEN b4 > a4 THEN (avg_discount - a4) / (b4 - a4) ELSE 0.5 END AS avg_discount_scaled,
   CASE WHEN b5 > a5 THEN (avg_margin - a5) / (b5 - a5) ELSE 0.5 END AS avg_margin_scaled
   FROM g, b)
SELECT city, revenue, orders, avg_price, avg_discount, avg_margin,
       round(revenue_scaled, 6) AS revenue_scaled, round(orders_scaled, 6) AS orders_scaled,
       round(avg_price_scaled, 6) AS avg_price_scaled, round(avg_discount_scaled, 6) AS avg_discount_scaled,
       round(avg_margin_scaled, 6) AS avg_margin_scaled,
       round((revenue_scaled + orders_scaled + avg_price_scaled + avg_discount_scaled + avg_margin_scaled) / 5 * 100.0, 6) AS score
FROM s
""")
def f06_minmax_score_city(spark, d):
    metrics = {"revenue": F.sum("revenue").cast("double"), "orders": F.sum("orders").cast("double"),
               "avg_price": F.round(F.avg("current_price"), 9),
               "avg_discount": F.sum("discount").cast("double") / F.count("discount"),
               "avg_margin": F.round(F.avg("margin_pct"), 9)}
    out = R.minmax_score(sales(spark, d), "city", metrics)
    return rnd(out, *[c for c in out.columns if c.endswith("_scaled")], "score")


@register("f07_quadrant_product", """
WITH g AS (SELECT product, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit,
                  CAST(sum(orders) AS BIGINT) AS orders FROM sales WHERE product IS NOT NULL GROUP BY product),
g2 AS (SELECT *, CASE WHEN revenue > 0 THEN profit / revenue * 100.0 ELSE 0.0 END AS margin FROM g),
m AS (SELECT quantile_cont(revenue, 0.5) AS median_revenue, quantile_cont(margin, 0.5) AS median_margin FROM g2),
q AS (SELECT g2.*, m.*, CASE WHEN revenue >= median_revenue AND margin >= median_margin THEN 'Star'
                            WHEN revenue >= median_revenue THEN 'Volume Driver'
                            WHEN margin >= median_margin THEN 'Growth Opportunity' ELSE 'Review' END AS quadrant FROM g2, m)
SELECT product, revenue, profit, orders, margin, round(median_revenue, 6) AS median_revenue,
       round(median_margin, 6) AS median_margin, quadrant, count(*) OVER (PARTITION BY quadrant) AS quadrant_count
FROM q
""")
def f07_quadrant_product(spark, d):
    return rnd(R.quadrant(sales(spark, d), "product"), "median_revenue", "median_margin")


@register("f08_top_category_per_city", """
SELECT * FROM (SELECT city, category, CAST(sum(revenue) AS DOUBLE) AS value,
  row_number() OVER (PARTITION BY city ORDER BY sum(revenue) DESC, category) AS rank
  FROM sales WHERE city IS NOT NULL AND category IS NOT NULL GROUP BY city, category) WHERE rank <= 1
""")
def f08_top_category_per_city(spark, d):
    return R.top_per_group(sales(spark, d), "city", "category", "revenue", 1)
