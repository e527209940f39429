"""Registered queries for root cause, insight facts (I02-I16) and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as I
from ..operators import retail as J
from ..operators import rootcause as RC
from ..operators.stats import boxplot_stats
from .catalog import register, rnd, table
from .sales_view import sales

FACT_COLS = ["rank", "fact", "subject", "value", "unit"]
_MID_SQL = """r AS (SELECT min(order_date) AS lo, max(order_date) AS hi, count(order_date) AS nv FROM sales),
m AS (SELECT *, lo + (hi - lo) / 2 AS mid FROM r),
h AS (SELECT s.*, CASE WHEN s.order_date >= m.mid THEN 'current' WHEN s.order_date < m.mid THEN 'previous' END AS half FROM sales s, m)"""


@register("i02_weakest_city", """
WITH g AS (SELECT city, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE city IS NOT NULL GROUP BY city)
SELECT 'city' AS dimension, (SELECT city FROM g ORDER BY v, city LIMIT 1) AS value, min(v) AS metric_value,
       CASE WHEN sum(v) <> 0 THEN min(v) / sum(v) * 100.0 ELSE 0.0 END AS share_of_total, count(*) AS n_segments FROM g
""")
def i02_weakest_city(spark, d):
    return RC.weakest_segment(sales(spark, d), "city", "revenue")


@register("i03_drill_down", """
WITH l1 AS (SELECT region AS k, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1),
w1 AS (SELECT k FROM l1 ORDER BY v, k LIMIT 1),
l2 AS (SELECT city AS k, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE region = (SELECT k FROM w1) GROUP BY 1),
w2 AS (SELECT k FROM l2 ORDER BY v, k LIMIT 1),
l3 AS (SELECT category AS k, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE region = (SELECT k FROM w1)
       AND city = (SELECT k FROM w2) GROUP BY 1),
w3 AS (SELECT k FROM l3 ORDER BY v, k LIMIT 1),
l4 AS (SELECT product AS k, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE region = (SELECT k FROM w1)
       AND city = (SELECT k FROM w2) AND category = (SELECT k FROM w3) GROUP BY 1)
SELECT 1 AS level, 'region' AS dimension, (SELECT k FROM w1) AS value, min(v) AS metric_value, round(min(v) / sum(v) * 100.0, 6) AS share_of_total, count(*) AS n_segments FROM l1
UNION ALL SELECT 2, 'city', (SELECT k FROM w2), min(v), round(min(v) / sum(v) * 100.0, 6), count(*) FROM l2
UNION ALL SELECT 3, 'category', (SELECT k FROM w3), min(v), round(min(v) / sum(v) * 100.0, 6), count(*) FROM l3
UNION ALL SELECT 4, 'product', (SELECT k FROM l4 ORDER BY v, k LIMIT 1), min(v), round(min(v) / sum(v) * 100.0, 6), count(*) FROM l4
""")
def i03_drill_down(spark, d):
    out = RC.drill_down(sales(spark, d), ["product", "category", "city", "region"], "revenue", "sum")
    return rnd(out, "share_of_total")


@register("i04_contributors_category", f"""
WITH {_MID_SQL},
g AS (SELECT category, CAST(coalesce(sum(CASE WHEN half = 'current' THEN revenue END), 0) AS DOUBLE) AS current,
             CAST(coalesce(sum(CASE WHEN half = 'previous' THEN revenue END), 0) AS DOUBLE) AS previous
      FROM h WHERE category IS NOT NULL GROUP BY category),
c AS (SELECT *, current - previous AS change FROM g)
SELECT category, current, previous, change,
       round(CASE WHEN (SELECT sum(change) FROM c) <> 0 THEN change / (SELECT sum(change) FROM c) * 100.0 ELSE 0.0 END, 6) AS contribution_pct
FROM c ORDER BY abs(change) DESC, category LIMIT 5
""")
def i04_contributors_category(spark, d):
    return rnd(RC.contributors_by_half(sales(spark, d), "order_date", "category", "revenue", 5), "contribution_pct")


@register("i04_contributors_two_frames")
def i04_contributors_two_frames(spark, d):
    s = sales(spark, d)
    cur = s.filter(F.year("order_date") == 2000)
    prev = s.filter(F.year("order_date") == 1999)
    return RC.contributors(cur, prev, "city", "revenue", "sum", 5)


@register("i05_insights")
def i05_insights(spark, d):
    return I.insights(sales(spark, d))


@register("i06_executive_summary", """
WITH c AS (SELECT category AS k, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE category IS NOT NULL GROUP BY 1),
y AS (SELECT city AS k, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE city IS NOT NULL GROUP BY 1),
p AS (SELECT product AS k, CAST(sum(revenue) AS DOUBLE) AS v FROM sales WHERE product IS NOT NULL GROUP BY 1),
t AS (SELECT CAST(sum(revenue) AS DOUBLE) AS rev, CAST(sum(profit) AS DOUBLE) AS pro FROM sales),
bc AS (SELECT * FROM c ORDER BY v DESC, k LIMIT 1), by_ AS (SELECT * FROM y ORDER BY v DESC, k LIMIT 1),
wy AS (SELECT * FROM y ORDER BY v ASC, k DESC LIMIT 1), bp AS (SELECT * FROM p ORDER BY v DESC, k LIMIT 1)
SELECT 1 AS rank, 'total_revenue' AS fact, CAST(NULL AS VARCHAR) AS subject, rev AS value, 'INR' AS unit FROM t
UNION ALL SELECT 2, 'margin_pct', NULL, CASE WHEN rev = 0 THEN 0.0 ELSE pro * 100.0 / rev END, 'pct' FROM t
UNION ALL SELECT 3, 'best_category', k, v, 'INR' FROM bc
UNION ALL SELECT 4, 'best_city', k, v, 'INR' FROM by_
UNION ALL SELECT 5, 'top_product', k, v, 'INR' FROM bp
UNION ALL SELECT 6, 'weakest_city_gap', wy.k, CASE WHEN (SELECT count(*) FROM y) > 1 AND wy.v > 0 THEN (by_.v - wy.v) / wy.v * 100.0 ELSE 0.0 END, 'pct' FROM wy, by_
""")
def i06_executive_summary(spark, d):
    return I.executive_summary(sales(spark, d)).select(*FACT_COLS)


@register("i07_evidence_city", """
WITH a AS (SELECT CAST(coalesce(sum(CASE WHEN city = 'NATION_5' THEN revenue END), 0) AS DOUBLE) AS rev, CAST(sum(revenue) AS DOUBLE) AS total,
                  CAST(sum(profit) AS DOUBLE) AS pall, avg(CASE WHEN city = 'NATION_5' THEN margin_pct END) AS margin,
                  CAST(sum(CASE WHEN city = 'NATION_5' THEN discount END) AS DOUBLE) / count(CASE WHEN city = 'NATION_5' THEN discount END) AS disc,
                  avg(CASE WHEN city = 'NATION_5' THEN CAST(promo = 'Yes' AS DOUBLE) END) AS ps FROM sales),
t AS (SELECT category AS k FROM sales WHERE city = 'NATION_5' AND category IS NOT NULL GROUP BY 1 ORDER BY sum(revenue) DESC, k LIMIT 1)
SELECT 1 AS rank, 'revenue' AS fact, 'NATION_5' AS subject, rev AS value, 'INR' AS unit FROM a
UNION ALL SELECT 2, 'share_pct', 'NATION_5', rev * 100.0 / total, 'pct' FROM a
UNION ALL SELECT 3, 'top_category', k, NULL, '' FROM t
UNION ALL SELECT 4, 'avg_row_margin_pct', 'NATION_5', round(margin, 6), 'pct' FROM a
UNION ALL SELECT 5, 'overall_margin_pct', NULL, pall * 100.0 / total, 'pct' FROM a
UNION ALL SELECT 6, 'avg_discount', 'NATION_5', disc, 'pct' FROM a
UNION ALL SELECT 7, 'promo_share_pct', 'NATION_5', round(ps * 100.0, 6), 'pct' FROM a
""")
def i07_evidence_city(spark, d):
    out = I.evidence(sales(spark, d), "city", "NATION_5").select(*FACT_COLS)
    return out.withColumn("value", F.when(F.col("fact").isin("avg_row_margin_pct", "promo_share_pct"),
                                          F.round("value", 6)).otherwise(F.col("value")))


@register("i08_compare_cities", """
WITH g AS (SELECT city, CAST(sum(revenue) AS DOUBLE) AS rev, CAST(sum(profit) AS DOUBLE) AS profit FROM sales WHERE city IS NOT NULL GROUP BY city),
a AS (SELECT * FROM g ORDER BY rev DESC, city LIMIT 1), b AS (SELECT * FROM g ORDER BY rev ASC, city DESC LIMIT 1)
SELECT a.city AS a, b.city AS b, a.rev AS rev_a, b.rev AS rev_b, CASE WHEN a.rev >= b.rev THEN a.city ELSE b.city END AS winner,
       CASE WHEN least(a.rev, b.rev) <> 0 THEN (greatest(a.rev, b.rev) - least(a.rev, b.rev)) / least(a.rev, b.rev) * 100.0 ELSE 0.0 END AS gap_pct,
       abs(a.rev - b.rev) AS revenue_gap, CASE WHEN a.rev >= b.rev THEN a.profit ELSE b.profit END AS winner_profit
FROM a, b
""")
def i08_compare_cities(spark, d):
    return I.compare(sales(spark, d), "city")


@register("i08_compare_named")
def i08_compare_named(spark, d):
    return I.compare(sales(spark, d), "category", "small", "ECONOMY", aliases={"small": "SMALL"})


@register("i09_recommendations", """
WITH city AS (SELECT city AS key, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(orders) AS DOUBLE) AS orders FROM sales
              WHERE city IS NOT NULL GROUP BY city),
category AS (SELECT category AS key, avg(CAST(margin_pct AS DOUBLE)) AS margin FROM sales WHERE category IS NOT NULL GROUP BY category),
discount AS (SELECT CAST(discount AS VARCHAR) AS key, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS revenue FROM sales
             WHERE discount IS NOT NULL GROUP BY discount),
promo AS (SELECT promo AS key, CAST(sum(revenue) AS DOUBLE) / count(revenue) AS revenue FROM sales GROUP BY promo),
lift AS (SELECT CASE WHEN n.revenue > 0 THEN (y.revenue - n.revenue) / n.revenue * 100 ELSE 0 END AS v
         FROM promo y, promo n WHERE y.key = 'Yes' AND n.key = 'No'),
facts AS (
SELECT 1 AS rank, 'investigate_city' AS fact, (SELECT key FROM city ORDER BY revenue, key DESC LIMIT 1) AS subject, CAST(NULL AS DOUBLE) AS value, '' AS unit
WHERE (SELECT count(*) FROM city) > 1
UNION ALL SELECT 2, 'review_margin_category', (SELECT key FROM category ORDER BY margin, key DESC LIMIT 1), NULL, ''
WHERE (SELECT count(*) FROM category) > 1
UNION ALL SELECT 3, 'standardize_discount', key, CAST(key AS DOUBLE), 'pct' FROM (SELECT key FROM discount ORDER BY revenue DESC, key LIMIT 1)
UNION ALL SELECT 4, 'low_value_city', (SELECT key FROM city WHERE orders <> 0 ORDER BY revenue / orders, key LIMIT 1), NULL, ''
UNION ALL SELECT 5, 'expand_promo', 'Yes', v, 'pct' FROM lift WHERE v > 5)
SELECT rank, fact, subject, round(value, 6) AS value, unit FROM facts
""")
def i09_recommendations(spark, d):
    return rnd(I.recommendations(sales(spark, d)).drop("sentence"), "value")


@register("i10_persona_manager")
def i10_persona_manager(spark, d):
    roles = {"revenue": "Measure", "orders": "Measure", "city": "Dimension", "category": "Dimension",
             "order_date": "Date"}
    return I.persona_insights(sales(spark, d), roles, "Manager")


@register("i10_persona_analyst")
def i10_persona_analyst(spark, d):
    roles = {"revenue": "Measure", "orders": "Measure", "discount": "Measure", "city": "Dimension",
             "category": "Dimension", "order_date": "Date"}
    return I.persona_insights(sales(spark, d), roles, "Analyst")


@register("i10_persona_hr")
def i10_persona_hr(spark, d):
    c = table(spark, d, "customer").select(F.col("c_acctbal").alias("salary"), F.col("c_mktsegment").alias("department"),
                                           F.col("c_nationkey").cast("double").alias("tenure_years"))
    return I.persona_insights(c, {"salary": "Measure", "department": "Dimension"}, "HR")


@register("i11_report_kpis", f"""
WITH {_MID_SQL},
a AS (SELECT CAST(coalesce(sum(CASE WHEN half = 'current' THEN revenue END), 0) AS DOUBLE) AS rc,
             CAST(coalesce(sum(CASE WHEN half = 'previous' THEN revenue END), 0) AS DOUBLE) AS rp,
             CAST(coalesce(sum(CASE WHEN half = 'current' THEN profit END), 0) AS DOUBLE) AS pc,
             CAST(coalesce(sum(CASE WHEN half = 'previous' THEN profit END), 0) AS DOUBLE) AS pp,
             CAST(coalesce(sum(CASE WHEN half = 'current' THEN orders END), 0) AS DOUBLE) AS oc,
             CAST(coalesce(sum(CASE WHEN half = 'previous' THEN orders END), 0) AS DOUBLE) AS op FROM h),
k AS (SELECT 'revenue' AS metric, rc AS current, rp AS previous FROM a
      UNION ALL SELECT 'profit', pc, pp FROM a UNION ALL SELECT 'orders', oc, op FROM a
      UNION ALL SELECT 'aov', rc / oc, rp / op FROM a
      UNION ALL SELECT 'margin', pc / rc * 100.0, pp / rp * 100.0 FROM a
      UNION ALL SELECT 'growth', (rc - rp) / abs(rp) * 100.0, NULL FROM a)
SELECT metric, round(current, 6) AS current, round(previous, 6) AS previous,
       round(CASE WHEN previous <> 0 THEN (current - previous) / abs(previous) * 100.0 END, 6) AS change_pct,
       CASE WHEN previous IS NULL OR previous = 0 THEN NULL WHEN current > previous THEN 'up' WHEN current < previous THEN 'down' ELSE 'flat' END AS direction
FROM k
""")
def i11_report_kpis(spark, d):
    out = I.report_kpis(sales(spark, d))
    return rnd(out, "current", "previous", "change_pct")


@register("i12_report_rankings", """
WITH r AS (SELECT 'regions' AS ranking, region AS key, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE region IS NOT NULL GROUP BY 2),
t AS (SELECT 'top_products' AS ranking, product AS key, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE product IS NOT NULL GROUP BY 2 ORDER BY value DESC, key LIMIT 10),
b AS (SELECT 'bottom_products' AS ranking, product AS key, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE product IS NOT NULL GROUP BY 2 ORDER BY value ASC, key DESC LIMIT 5),
c AS (SELECT 'categories' AS ranking, category AS key, CAST(sum(revenue) AS DOUBLE) AS value FROM sales WHERE category IS NOT NULL GROUP BY 2),
u AS (SELECT * FROM r UNION ALL SELECT * FROM t UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT ranking, key, value, round(value * 100.0 / sum(value) OVER (PARTITION BY ranking), 6) AS share_pct FROM u
""")
def i12_report_rankings(spark, d):
    return rnd(I.report_rankings(sales(spark, d)), "share_pct")


@register("i13_region_vs_prior", f"""
WITH {_MID_SQL},
g AS (SELECT region, CAST(coalesce(sum(CASE WHEN half = 'current' THEN revenue END), 0) AS DOUBLE) AS current,
             CAST(coalesce(sum(CASE WHEN half = 'previous' THEN revenue END), 0) AS DOUBLE) AS previous
      FROM h WHERE region IS NOT NULL GROUP BY region)
SELECT region, current, previous, round(current * 100.0 / (SELECT sum(current) FROM g), 6) AS share_pct,
       round(CASE WHEN previous <> 0 THEN (current - previous) / abs(previous) * 100.0 END, 6) AS growth_pct
FROM g ORDER BY current DESC, region LIMIT 10
""")
def i13_region_vs_prior(spark, d):
    return rnd(I.region_vs_prior(sales(spark, d)), "share_pct", "growth_pct")


@register("i14_highlights")
def i14_highlights(spark, d):
    s = sales(spark, d)
    return I.highlights(I.report_kpis(s), I.report_rankings(s))


@register("i16_boxplot_insights_price", """
WITH b AS (SELECT CAST(current_price AS DOUBLE) AS v FROM sales WHERE current_price IS NOT NULL),
s AS (SELECT count(v) AS n, avg(v) AS mean, skewness(v) AS skew, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM b),
o AS (SELECT count(*) AS outlier_count FROM b, s WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)),
r AS (SELECT *, CASE WHEN mean <> 0 THEN (q3 - q1) / mean * 100 ELSE 0 END AS ratio FROM s, o)
SELECT round(median, 6) AS median, round(skew, 6) AS skew,
       CASE WHEN skew > 0.3 THEN 'positively skewed (right-tailed)' WHEN skew < -0.3 THEN 'negatively skewed (left-tailed)'
            ELSE 'fairly symmetric' END AS skew_word,
       round(ratio, 6) AS iqr_to_mean_pct, CASE WHEN ratio > 60 THEN 'high' WHEN ratio > 25 THEN 'moderate' ELSE 'low' END AS variability,
       outlier_count, round(outlier_count * 100.0 / n, 6) AS outlier_pct, round(q1, 6) AS q1, round(q3, 6) AS q3 FROM r
""")
def i16_boxplot_insights_price(spark, d):
    return rnd(I.boxplot_insights(boxplot_stats(sales(spark, d), "current_price")), "median", "skew", "iqr_to_mean_pct",
               "outlier_pct", "q1", "q3")


@register("j01_sla_stats_events", """
WITH b AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
a AS (SELECT count(*) AS n, avg(v) AS avg, avg(CASE WHEN v <= 12.0 THEN 1.0 ELSE 0.0 END) * 100.0 AS on_time_pct,
             quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90 FROM b)
SELECT n, round(avg, 6) AS avg, round(on_time_pct, 6) AS on_time_pct, round(p50, 6) AS p50, round(p90, 6) AS p90,
       CASE WHEN on_time_pct >= 95 THEN 'EXCELLENT' WHEN on_time_pct >= 85 THEN 'NEEDS ATTENTION' ELSE 'CRITICAL' END AS status,
       10.0 AS promise FROM a
""", with_sales=False)
def j01_sla_stats_events(spark, d):
    return rnd(J.sla_stats(table(spark, d, "events"), "value", 10.0, 2.0), "avg", "on_time_pct", "p50", "p90")


@register("j01_sla_histogram_events", """
WITH b AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM b),
c AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((v - lo) / ((hi - lo) / 12)) AS INTEGER), 11) END AS bin,
             count(*) AS count FROM b, r GROUP BY 1),
s AS (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS bin),
e AS (SELECT s.bin, lo + s.bin * ((hi - lo) / 12) AS bin_start, CASE WHEN s.bin = 11 THEN hi ELSE lo + (s.bin + 1) * ((hi - lo) / 12) END AS bin_end,
             coalesce(c.count, 0) AS count FROM s CROSS JOIN r LEFT JOIN c ON s.bin = c.bin)
SELECT bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, count, round((bin_start + bin_end) / 2, 6) AS center FROM e
""", with_sales=False)
def j01_sla_histogram_events(spark, d):
    return rnd(J.sla_histogram(table(spark, d, "events"), "value", 12), "bin_start", "bin_end", "center")


@register("j02_days_of_cover", """
WITH v AS (SELECT product, CAST(sum(orders) AS BIGINT) AS velocity FROM sales WHERE product IS NOT NULL GROUP BY product
           ORDER BY velocity DESC, product LIMIT 10),
s AS (SELECT p_name AS product, sum(p_size) AS stock_left FROM part GROUP BY p_name),
j AS (SELECT v.*, s.stock_left, greatest(1, CAST(floor(velocity * 0.3) AS BIGINT)) AS daily_sales FROM v LEFT JOIN s USING (product))
SELECT product, velocity, stock_left, daily_sales, round(stock_left / daily_sales, 1) AS days_cover,
       CASE WHEN stock_left IS NULL THEN NULL WHEN round(stock_left / daily_sales, 1) < 1 THEN 'CRITICAL'
            WHEN round(stock_left / daily_sales, 1) < 2 THEN 'LOW' ELSE 'OK' END AS risk,
       CASE WHEN stock_left IS NULL THEN NULL WHEN round(stock_left / daily_sales, 1) < 1 THEN 'ORDER NOW'
            WHEN round(stock_left / daily_sales, 1) < 2 THEN 'Plan Reorder' ELSE 'Sufficient' END AS action
FROM j
""")
def j02_days_of_cover(spark, d):
    stock = table(spark, d, "part").groupBy("p_name").agg(F.sum("p_size").alias("stock"))
    return J.days_of_cover(sales(spark, d), stock, "product", "orders", 10)


@register("j03_defect_funnel_orders", """
WITH c AS (SELECT count(*) AS total, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS d0,
                  count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS d1 FROM orders)
SELECT 0 AS step, 'Total Orders' AS label, total AS remaining, 0 AS removed, total, d0 + d1 AS total_defects,
       (d0 + d1) * 100.0 / total AS defect_rate_pct FROM c
UNION ALL SELECT 1, 'After P', total - d0, d0, total, d0 + d1, (d0 + d1) * 100.0 / total FROM c
UNION ALL SELECT 2, 'After O', total - d0 - d1, d1, total, d0 + d1, (d0 + d1) * 100.0 / total FROM c
""", with_sales=False)
def j03_defect_funnel_orders(spark, d):
    return J.defect_funnel(table(spark, d, "orders"), "o_orderstatus", ["P", "O"])


@register("j04_week_over_week", """
WITH g AS (SELECT date_trunc('week', order_date) AS week, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(orders) AS DOUBLE) AS orders
           FROM sales WHERE order_date IS NOT NULL GROUP BY 1),
l AS (SELECT *, lag(revenue) OVER (ORDER BY week) AS revenue_prev, lag(orders) OVER (ORDER BY week) AS orders_prev FROM g)
SELECT week, revenue, revenue_prev,
       CASE WHEN revenue_prev IS NOT NULL AND revenue_prev <> 0 THEN (revenue - revenue_prev) / abs(revenue_prev) * 100.0 END AS revenue_change_pct,
       orders, orders_prev,
       CASE WHEN orders_prev IS NOT NULL AND orders_prev <> 0 THEN (orders - orders_prev) / abs(orders_prev) * 100.0 END AS orders_change_pct
FROM l
""")
def j04_week_over_week(spark, d):
    out = J.week_over_week(sales(spark, d), "order_date", {"revenue": "revenue", "orders": "orders"})
    return out.drop("revenue_label", "orders_label").withColumn("week", F.col("week").cast("timestamp_ntz"))


@register("j05_new_vs_repeat", """
WITH p AS (SELECT DISTINCT o_custkey AS cust, date_trunc('week', o_orderdate) AS period FROM orders),
f AS (SELECT cust, min(period) AS cohort FROM p GROUP BY cust)
SELECT period, count(CASE WHEN period = cohort THEN 1 END) AS new_customers,
       count(CASE WHEN period > cohort THEN 1 END) AS repeat_customers FROM p JOIN f USING (cust) GROUP BY period
""", with_sales=False)
def j05_new_vs_repeat(spark, d):
    out = J.new_vs_repeat(table(spark, d, "orders"), "o_custkey", "o_orderdate", "week")
    return out.withColumn("period", F.col("period").cast("timestamp_ntz"))


@register("j06_cohort_retention", """
WITH p AS (SELECT DISTINCT o_custkey AS cust, date_trunc('month', o_orderdate) AS period FROM orders),
f AS (SELECT cust, min(period) AS cohort FROM p GROUP BY cust),
g AS (SELECT cohort, CAST(datediff('month', cohort, period) AS INTEGER) AS "offset", count(*) AS customers FROM p JOIN f USING (cust) GROUP BY 1, 2)
SELECT g.cohort, g."offset", g.customers, s.customers AS cohort_size, g.customers * 100.0 / s.customers AS retention_pct
FROM g JOIN (SELECT cohort, customers FROM g WHERE "offset" = 0) s USING (cohort)
""", with_sales=False)
def j06_cohort_retention(spark, d):
    out = J.cohort_retention(table(spark, d, "orders"), "o_custkey", "o_orderdate", "month")
    return out.withColumn("cohort", F.col("cohort").cast("timestamp_ntz"))


@register("j07_optional_distributions", """
WITH l AS (SELECT 'discount' AS k, CAST(discount AS DOUBLE) AS v FROM sales UNION ALL SELECT 'orders', CAST(orders AS DOUBLE) FROM sales
           UNION ALL SELECT 'current_price', current_price FROM sales),
r AS (SELECT k, min(v) AS lo, max(v) AS hi FROM l WHERE v IS NOT NULL GROUP BY k),
c AS (SELECT l.k, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((v - lo) / ((hi - lo) / 20)) AS INTEGER), 19) END AS bin, count(*) AS count
      FROM l JOIN r USING (k) WHERE v IS NOT NULL GROUP BY 1, 2),
s AS (SELECT k, lo, hi, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM r)
SELECT s.k AS "column", s.bin, lo + s.bin * ((hi - lo) / 20) AS bin_start,
       CASE WHEN s.bin = 19 THEN hi ELSE lo + (s.bin + 1) * ((hi - lo) / 20) END AS bin_end, coalesce(c.count, 0) AS count
FROM s LEFT JOIN c ON s.k = c.k AND s.bin = c.bin
""")
def j07_optional_distributions(spark, d):
    return J.optional_column_distributions(sales(spark, d), ["discount", "orders", "current_price", "Delivery Time"])
