"""Registered queries for the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from .catalog import register, rnd, table
from .sales_view import sales


@register("e01_kpis", """
SELECT CAST(t.rev AS DOUBLE) AS total_revenue, CAST(t.pro AS DOUBLE) AS total_profit,
       CAST(t.ord AS BIGINT) AS total_orders, round(t.ap, 6) AS avg_price, t.n AS record_count,
       round(t.rm, 6) AS revenue_mean, round(t.rs, 6) AS revenue_std,
       cat.k AS top_category, CAST(cat.v AS DOUBLE) AS top_category_rev,
       city.k AS top_city, CAST(city.v AS DOUBLE) AS top_city_rev,
       prod.k AS top_product, CAST(prod.v AS DOUBLE) AS top_product_rev,
       CASE WHEN t.rev = 0 THEN 0.0 ELSE CAST(t.pro AS DOUBLE) * 100.0 / CAST(t.rev AS DOUBLE) END AS profit_margin,
       CASE WHEN t.ord = 0 THEN 0.0 ELSE CAST(t.rev AS DOUBLE) / CAST(t.ord AS DOUBLE) END AS aov
FROM (SELECT sum(revenue) rev, sum(profit) pro, sum(orders) ord, avg(current_price) ap, count(*) n,
             avg(CAST(revenue AS DOUBLE)) rm, stddev_samp(CAST(revenue AS DOUBLE)) rs FROM sales) t,
     (SELECT category k, sum(revenue) v FROM sales WHERE category IS NOT NULL GROUP BY 1 ORDER BY v DESC, k LIMIT 1) cat,
     (SELECT city k, sum(revenue) v FROM sales WHERE city IS NOT NULL GROUP BY 1 ORDER BY v DESC, k LIMIT 1) city,
     (SELECT product k, sum(revenue) v FROM sales WHERE product IS NOT NULL GROUP BY 1 ORDER BY v DESC, k LIMIT 1) prod
""")
def e01_kpis(spark, d):
    return rnd(A.kpis(sales(spark, d)), "avg_price", "revenue_mean", "revenue_std")


@register("e02_revenue_by_city", """
SELECT city, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE city IS NOT NULL GROUP BY city
""")
def e02_revenue_by_city(spark, d):
    return A.revenue_by(sales(spark, d), "city")


@register("e02_revenue_by_category", """
SELECT category, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE category IS NOT NULL GROUP BY category
""")
def e02_revenue_by_category(spark, d):
    return A.revenue_by(sales(spark, d), "category")


@register("e03_top_products", """
SELECT product, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE product IS NOT NULL
GROUP BY product ORDER BY revenue DESC, product LIMIT 10
""")
def e03_top_products(spark, d):
    return A.top_n(sales(spark, d), "product", "revenue", 10)


@register("e03_bottom_products", """
SELECT product, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE product IS NOT NULL
GROUP BY product ORDER BY revenue ASC, product DESC LIMIT 5
""")
def e03_bottom_products(spark, d):
    return A.bottom_n(sales(spark, d), "product", "revenue", 5)


@register("e04_pivot_category_city", """
WITH s AS (SELECT category, city, revenue FROM sales WHERE category IS NOT NULL AND city IS NOT NULL),
cells AS (SELECT category, city FROM (SELECT DISTINCT category FROM s), (SELECT DISTINCT city FROM s))
SELECT c.category, c.city, CAST(coalesce(sum(s.revenue), 0) AS DOUBLE) AS revenue
FROM cells c LEFT JOIN s ON s.category = c.category AND s.city = c.city GROUP BY c.category, c.city
""")
def e04_pivot_category_city(spark, d):
    wide = A.pivot_sum(sales(spark, d), "category", "city", "revenue")
    return wide.unpivot("category", [f"`{c}`" for c in wide.columns if c != "category"], "city", "revenue")


@register("e05_promo_impact", """
SELECT category, promo, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_revenue
FROM sales WHERE category IS NOT NULL AND promo IS NOT NULL GROUP BY category, promo
""")
def e05_promo_impact(spark, d):
    return A.promo_impact(sales(spark, d))


@register("e06_discount_curve", """
WITH g AS (SELECT discount, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_revenue,
                  CAST(sum(orders) AS DOUBLE) / count(orders) AS avg_orders, count(orders) AS count
           FROM sales WHERE discount IS NOT NULL GROUP BY discount)
SELECT g.*, g.discount = (SELECT discount FROM g ORDER BY avg_revenue DESC, discount LIMIT 1) AS is_sweet_spot
FROM g
""")
def e06_discount_curve(spark, d):
    return A.discount_curve(sales(spark, d))


_TIER_SQL = """CASE WHEN current_price > 0 AND current_price <= 60 THEN '₹20–60'
  WHEN current_price > 60 AND current_price <= 100 THEN '₹61–100'
  WHEN current_price > 100 AND current_price <= 140 THEN '₹101–140'
  WHEN current_price > 140 AND current_price <= 180 THEN '₹141–180'
  WHEN current_price > 180 THEN '₹181+' END"""
_TIER_ORD_SQL = """CASE WHEN current_price > 0 AND current_price <= 60 THEN 0
  WHEN current_price > 60 AND current_price <= 100 THEN 1
  WHEN current_price > 100 AND current_price <= 140 THEN 2
  WHEN current_price > 140 AND current_price <= 180 THEN 3
  WHEN current_price > 180 THEN 4 END"""


@register("e07_revenue_by_tier", f"""
SELECT tier, price_tier_ord, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM (SELECT {_TIER_SQL} AS tier, {_TIER_ORD_SQL} AS price_tier_ord, revenue FROM sales)
WHERE tier IS NOT NULL GROUP BY tier, price_tier_ord
""")
def e07_revenue_by_tier(spark, d):
    return A.revenue_by_tier(sales(spark, d))


@register("c07_price_tier_counts", f"""
SELECT {_TIER_SQL} AS price_tier, {_TIER_ORD_SQL} AS price_tier_ord, count(*) AS n
FROM sales GROUP BY 1, 2
""")
def c07_price_tier_counts(spark, d):
    return (A.add_price_tier(sales(spark, d)).groupBy("price_tier", "price_tier_ord")
            .agg(F.count(F.lit(1)).alias("n")))


@register("e09_promo_ranking", """
SELECT promo, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(revenue) AS DOUBLE) AS revenue,
       CASE WHEN sum(orders) = 0 THEN 0.0 ELSE CAST(sum(revenue) AS DOUBLE) / CAST(sum(orders) AS DOUBLE) END AS aov
FROM sales WHERE promo IN ('Yes', 'No') GROUP BY promo
""")
def e09_promo_ranking(spark, d):
    return A.promo_ranking(sales(spark, d))


@register("e10_city_performance", """
SELECT city, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit,
       CAST(sum(orders) AS BIGINT) AS orders,
       CASE WHEN sum(revenue) > 0 THEN CAST(sum(profit) AS DOUBLE) / CAST(sum(revenue) AS DOUBLE) * 100.0 ELSE 0.0 END AS margin
FROM sales WHERE city IS NOT NULL GROUP BY city
""")
def e10_city_performance(spark, d):
    return A.dimension_performance(sales(spark, d), "city")


@register("e11_product_performance", """
WITH m AS (SELECT product, category, row_number() OVER (PARTITION BY product ORDER BY count(*) DESC, category) AS rn
           FROM sales WHERE product IS NOT NULL AND category IS NOT NULL GROUP BY product, category),
g AS (SELECT product, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit,
             CAST(sum(orders) AS BIGINT) AS orders FROM sales WHERE product IS NOT NULL GROUP BY product)
SELECT g.*, m.category,
       CASE WHEN g.revenue > 0 THEN g.profit / g.revenue * 100.0 ELSE 0.0 END AS margin
FROM g LEFT JOIN m ON g.product = m.product AND m.rn = 1
ORDER BY revenue DESC, product LIMIT 10
""")
def e11_product_performance(spark, d):
    return A.product_performance(sales(spark, d), "revenue", 10)


def _geo_from_nation(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_name").alias("city"), F.col("n_nationkey").cast("double").alias("lat"),
                    F.col("n_regionkey").cast("double").alias("lon"))


@register("e12_location_performance", """
WITH g AS (SELECT city, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(orders) AS BIGINT) AS orders,
                  CAST(sum(profit) AS DOUBLE) AS profit, avg(margin_pct) AS avg_row_margin_pct
           FROM sales WHERE city IS NOT NULL GROUP BY city),
j AS (SELECT g.*, CAST(n.n_nationkey AS DOUBLE) AS lat, CAST(n.n_regionkey AS DOUBLE) AS lon,
             n.n_name IS NOT NULL AS mapped FROM g LEFT JOIN nation n ON g.city = n.n_name),
s AS (SELECT sum(greatest(revenue, 0.0)) AS pos_total, max(revenue) AS best, min(revenue) AS worst FROM j WHERE mapped)
SELECT j.city, j.revenue, j.orders, j.profit, round(j.avg_row_margin_pct, 6) AS avg_row_margin_pct, j.lat, j.lon,
       j.mapped, CAST(row_number() OVER (ORDER BY j.revenue DESC, j.city) AS BIGINT) AS rank,
       CASE WHEN s.worst > 0 THEN (s.best - s.worst) / s.worst * 100.0 ELSE 0.0 END AS gap_pct,
       CASE WHEN s.pos_total = 0 THEN 0.0 ELSE greatest(j.revenue, 0.0) * 100.0 / s.pos_total END AS share_pct
FROM j, s
""")
def e12_location_performance(spark, d):
    out = A.location_performance(sales(spark, d), _geo_from_nation(spark, d))
    return rnd(out, "avg_row_margin_pct")


@register("e13_city_operations", """
SELECT city, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(revenue) AS DOUBLE) AS revenue,
       (SELECT count(DISTINCT city) FROM sales) AS n_cities,
       (SELECT count(DISTINCT product) FROM sales) AS n_products,
       (SELECT count(*) FROM sales) AS n_lines
FROM sales WHERE city IS NOT NULL GROUP BY city
""")
def e13_city_operations(spark, d):
    return A.city_operations(sales(spark, d))


@register("e14_movers", """
(SELECT product, CAST(sum(orders) AS BIGINT) AS orders, 'fast' AS kind FROM sales WHERE product IS NOT NULL
 GROUP BY product ORDER BY orders DESC, product ASC LIMIT 8)
UNION ALL
(SELECT product, CAST(sum(orders) AS BIGINT) AS orders, 'slow' AS kind FROM sales WHERE product IS NOT NULL
 GROUP BY product ORDER BY orders ASC, product DESC LIMIT 8)
""")
def e14_movers(spark, d):
    return A.movers(sales(spark, d), 8)


@register("e15_median_revenue_by_segment", """
SELECT segment, round(quantile_cont(CAST(revenue AS DOUBLE), 0.5), 6) AS value FROM sales
WHERE segment IS NOT NULL GROUP BY segment ORDER BY value DESC, segment LIMIT 10
""")
def e15_median_revenue_by_segment(spark, d):
    spec = A.AggSpec(metric="revenue", dimension="segment", aggregation="median", top_n=10)
    return rnd(A.aggregate(sales(spark, d), spec), "value")


@register("e15_distinct_customers_by_region", """
SELECT region, count(DISTINCT customer_id) AS value FROM sales WHERE region IS NOT NULL
GROUP BY region ORDER BY value ASC, region LIMIT 3
""")
def e15_distinct_customers_by_region(spark, d):
    spec = A.AggSpec(metric="customer_id", dimension="region", aggregation="count_distinct",
                     top_n=3, sort="asc")
    return A.aggregate(sales(spark, d), spec)


@register("e15_total_mean_price", """
SELECT 'current_price' AS label, round(avg(current_price), 6) AS value FROM sales
""")
def e15_total_mean_price(spark, d):
    spec = A.AggSpec(metric="current_price", dimension=None, aggregation="mean")
    return rnd(A.aggregate(sales(spark, d), spec), "value")


@register("e16_aggregate_insight_city", """
WITH s AS (SELECT city, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE city IS NOT NULL GROUP BY city),
l AS (SELECT city, value FROM s ORDER BY value DESC, city LIMIT 1),
t AS (SELECT city, value FROM s ORDER BY value ASC, city DESC LIMIT 1),
a AS (SELECT sum(value) AS total, avg(value) AS mean, count(*) AS n FROM s)
SELECT l.city AS leader, l.value AS leader_value,
       CASE WHEN a.total = 0 THEN 0.0 ELSE l.value * 100.0 / a.total END AS share_pct,
       round(CASE WHEN a.mean = 0 THEN 0.0 ELSE (l.value - a.mean) * 100.0 / a.mean END, 6) AS vs_avg_pct,
       CASE WHEN a.n > 1 THEN t.city END AS trailing, CASE WHEN a.n > 1 THEN t.value END AS trailing_value,
       a.n AS groups
FROM l, t, a
""")
def e16_aggregate_insight_city(spark, d):
    series = A.aggregate(sales(spark, d), A.AggSpec(metric="revenue", dimension="city", top_n=None))
    return rnd(A.aggregate_insight(series, "city", "value"), "vs_avg_pct")


@register("e17_measure_totals", """
SELECT 'revenue' AS measure, CAST(sum(revenue) AS DOUBLE) AS total, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS mean FROM sales
UNION ALL SELECT 'orders', CAST(sum(orders) AS DOUBLE), CAST(sum(orders) AS DOUBLE) / count(orders) FROM sales
UNION ALL SELECT 'profit', CAST(sum(profit) AS DOUBLE), CAST(sum(profit) AS DOUBLE) / count(profit) FROM sales
UNION ALL SELECT 'discount', CAST(sum(discount) AS DOUBLE), CAST(sum(discount) AS DOUBLE) / count(discount) FROM sales
""")
def e17_measure_totals(spark, d):
    return A.measure_totals(sales(spark, d), ["revenue", "orders", "profit", "discount"])


@register("e18_breakdowns", """
WITH u AS (
  SELECT 'category' AS dimension, CAST(category AS VARCHAR) AS value_label, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE category IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'city', CAST(city AS VARCHAR), CAST(sum(revenue) AS DOUBLE) FROM sales WHERE city IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'segment', CAST(segment AS VARCHAR), CAST(sum(revenue) AS DOUBLE) FROM sales WHERE segment IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'brand', CAST(brand AS VARCHAR), CAST(sum(revenue) AS DOUBLE) FROM sales WHERE brand IS NOT NULL GROUP BY 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, value_label) AS rank FROM u)
WHERE rank <= 12
""")
def e18_breakdowns(spark, d):
    return A.breakdowns(sales(spark, d), ["category", "city", "segment", "brand"], "revenue", 12)


def _ctx_sql() -> str:
    parts = ["""SELECT 'total' AS grouping, CAST(NULL AS VARCHAR) AS key, CAST(sum(revenue) AS DOUBLE) AS revenue,
  CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(profit) AS DOUBLE) AS profit, count(*) AS lines,
  round(avg(margin_pct), 6) AS avg_row_margin_pct, CAST(sum(discount) AS DOUBLE) / count(discount) AS avg_discount,
  CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_revenue, CAST(sum(orders) AS DOUBLE) / count(orders) AS avg_orders
FROM sales"""]
    for k in ("category", "city", "product", "promo", "discount"):
        parts.append(f"""SELECT '{k}', CAST({k} AS VARCHAR), CAST(sum(revenue) AS DOUBLE), CAST(sum(orders) AS BIGINT),
  CAST(sum(profit) AS DOUBLE), count(*), round(avg(margin_pct), 6), CAST(sum(discount) AS DOUBLE) / count(discount),
  CAST(sum(revenue) AS DOUBLE) / count(revenue), CAST(sum(orders) AS DOUBLE) / count(orders)
FROM sales WHERE {k} IS NOT NULL GROUP BY CAST({k} AS VARCHAR)""")
    return "\nUNION ALL\n".join(parts)


@register("e19_context_bundle", _ctx_sql())
def e19_context_bundle(spark, d):
    return rnd(A.context_bundle(sales(spark, d)), "avg_row_margin_pct")


@register("e19_context_totals", """
WITH m AS (SELECT count(DISTINCT product) AS n_products, count(DISTINCT city) AS n_cities, count(DISTINCT category) AS n_categories,
  CAST(sum(revenue) FILTER (WHERE promo = 'Yes') AS DOUBLE) / count(revenue) FILTER (WHERE promo = 'Yes') AS rev_y,
  CAST(sum(revenue) FILTER (WHERE promo = 'No') AS DOUBLE) / count(revenue) FILTER (WHERE promo = 'No') AS rev_n,
  CAST(sum(orders) FILTER (WHERE promo = 'Yes') AS DOUBLE) / count(orders) FILTER (WHERE promo = 'Yes') AS ord_y,
  CAST(sum(orders) FILTER (WHERE promo = 'No') AS DOUBLE) / count(orders) FILTER (WHERE promo = 'No') AS ord_n
FROM sales)
SELECT n_products, n_cities, n_categories,
       round(CASE WHEN rev_n > 0 THEN (rev_y - rev_n) / rev_n * 100 ELSE 0 END, 6) AS rev_lift_pct,
       round(CASE WHEN ord_n > 0 THEN (ord_y - ord_n) / ord_n * 100 ELSE 0 END, 6) AS ord_lift_pct
FROM m
""")
def e19_context_totals(spark, d):
    return rnd(A.context_totals(A.context_bundle(sales(spark, d))))


@register("e20_unit_economics", """
WITH t AS (SELECT CAST(sum(revenue) AS DOUBLE) / count(revenue) AS avg_revenue, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
                  CAST(sum(orders) AS BIGINT) AS total_orders FROM sales)
SELECT round(avg_revenue, 6) AS avg_revenue, total_revenue, total_orders,
       round(avg_revenue * 0.52, 6) AS cogs_cost, round(avg_revenue * 0.12, 6) AS rider_cost,
       round(avg_revenue * 0.03, 6) AS packaging_cost, round(avg_revenue * 0.02, 6) AS gateway_cost,
       round(avg_revenue * 0.05, 6) AS promos_cost,
       round(avg_revenue * (1 - 0.52 - 0.12 - 0.03 - 0.02 - 0.05), 6) AS net_profit,
       round(CASE WHEN avg_revenue > 0 THEN 100.0 * (1 - 0.52 - 0.12 - 0.03 - 0.02 - 0.05) ELSE 0 END, 6) AS contribution_pct,
       round(avg_revenue * 0.15, 6) AS delivery_cost_per_order,
       round(avg_revenue * 0.15 * total_orders, 6) AS total_delivery_cost,
       round(avg_revenue * 0.15 * total_orders * 100.0 / total_revenue, 6) AS delivery_pct_of_revenue
FROM t
""")
def e20_unit_economics(spark, d):
    return rnd(A.unit_economics(sales(spark, d)), dp=6)


@register("e21_value_counts_segment", """
SELECT segment, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM sales WHERE segment IS NOT NULL GROUP BY segment
""")
def e21_value_counts_segment(spark, d):
    return A.value_counts(sales(spark, d), "segment")


@register("e22_crosstab_share", """
WITH c AS (SELECT segment, promo, count(*) AS n FROM sales WHERE segment IS NOT NULL AND promo IS NOT NULL GROUP BY 1, 2),
ft AS (SELECT min(promo) AS ft FROM c),
g AS (SELECT segment, sum(n) AS total, sum(CASE WHEN promo = ft THEN n ELSE 0 END) AS first_n, min(ft) AS first_target
      FROM c, ft GROUP BY segment ORDER BY total DESC, segment LIMIT 8),
s AS (SELECT *, CAST(first_n AS DOUBLE) / total AS share_first FROM g)
SELECT s.*, s.segment = (SELECT segment FROM s ORDER BY share_first DESC, segment LIMIT 1) AS is_best,
       s.segment = (SELECT segment FROM s ORDER BY share_first ASC, segment LIMIT 1) AS is_worst
FROM s
""")
def e22_crosstab_share(spark, d):
    return A.crosstab_share(sales(spark, d), "segment", "promo", 8)


@register("e23_financial_breakdown", """
SELECT CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(NULL AS DOUBLE) AS cogs, CAST(sum(profit) AS DOUBLE) AS gross_profit,
       CASE WHEN sum(revenue) = 0 THEN 0.0 ELSE CAST(sum(profit) AS DOUBLE) * 100.0 / CAST(sum(revenue) AS DOUBLE) END AS gross_margin_pct
FROM sales
""")
def e23_financial_breakdown(spark, d):
    return A.financial_breakdown(sales(spark, d))


@register("e24_revenue_per_order_city", """
SELECT city, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(orders) AS BIGINT) AS orders,
       CAST(sum(revenue) AS DOUBLE) / CAST(sum(orders) AS DOUBLE) AS revenue_per_order
FROM sales WHERE city IS NOT NULL GROUP BY city HAVING sum(orders) <> 0
""")
def e24_revenue_per_order_city(spark, d):
    return A.revenue_per_order(sales(spark, d), "city")


@register("e25_loss_making_products", """
SELECT product, CAST(sum(profit) AS DOUBLE) AS profit FROM sales WHERE product IS NOT NULL
GROUP BY product HAVING sum(profit) < 0
""")
def e25_loss_making_products(spark, d):
    return A.loss_making(sales(spark, d), "product")
