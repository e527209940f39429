"""Registered queries for the statistics operators (G01-G17) and promo statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import stats as G
from ..operators.aggregate import promo_stats
from .catalog import register, rnd
from .sales_view import sales

CORR_COLS = ["original_price", "current_price", "discount", "orders", "revenue", "profit", "margin_pct"]


def _moments_sql(col: str) -> str:
    """Population skewness / excess kurtosis in DuckDB from its adjusted / pop functions."""
    return f"""count({col}) AS n,
      skewness({col}) * (count({col}) - 2) / sqrt(count({col}) * (count({col}) - 1.0)) AS skewness,
      kurtosis_pop({col}) AS kurtosis"""


@register("g01_describe_revenue", f"""
SELECT n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(variance, 0) AS variance,
       round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis
FROM (SELECT avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS std, var_pop(v) AS variance, {_moments_sql('v')}
      FROM (SELECT CAST(revenue AS DOUBLE) AS v FROM sales))
""")
def g01_describe_revenue(spark, d):
    out = rnd(G.describe_measure(sales(spark, d), "revenue"), "mean", "median", "std", "skewness", "kurtosis")
    # variances of money amounts are ~1e9: compared at 0 dp (~13 significant digits)
    return out.withColumn("variance", F.round("variance", 0))


@register("g02_zscore_outliers_revenue", """
WITH s AS (SELECT avg(CAST(revenue AS DOUBLE)) mu, stddev_pop(CAST(revenue AS DOUBLE)) sd FROM sales),
f AS (SELECT product, city, category, CAST(revenue AS DOUBLE) AS revenue,
             abs(CAST(revenue AS DOUBLE) - s.mu) / s.sd AS z_score FROM sales, s
      WHERE abs(CAST(revenue AS DOUBLE) - s.mu) / s.sd > 2)
SELECT product, city, category, revenue, round(z_score, 6) AS z_score, (SELECT count(*) FROM f) AS outlier_count
FROM f ORDER BY z_score DESC, product, city, category, revenue LIMIT 10
""")
def g02_zscore_outliers_revenue(spark, d):
    s = sales(spark, d).select("product", "city", "category", F.col("revenue").cast("double").alias("revenue"))
    return rnd(G.zscore_outliers(s, "revenue", 2.0, 10), "z_score")


@register("g03_top_anomaly_revenue", """
WITH s AS (SELECT avg(CAST(revenue AS DOUBLE)) mu, stddev_pop(CAST(revenue AS DOUBLE)) sd, count(*) n FROM sales),
r AS (SELECT product, city, category, CAST(revenue AS DOUBLE) AS revenue,
             abs(CAST(revenue AS DOUBLE) - s.mu) / s.sd AS z, s.mu, s.n FROM sales, s)
SELECT product, city, category, revenue, round(z, 6) AS z, CASE WHEN revenue > mu THEN 'spike' ELSE 'drop' END AS direction
FROM r WHERE n >= 5 AND z >= 3 ORDER BY z DESC, product, city, category LIMIT 1
""")
def g03_top_anomaly_revenue(spark, d):
    return rnd(G.top_anomaly(sales(spark, d), "revenue", 3.0), "z")


@register("g04_normality_revenue", f"""
WITH m AS (SELECT {_moments_sql('v')} FROM (SELECT CAST(revenue AS DOUBLE) AS v FROM sales)),
j AS (SELECT n, skewness, kurtosis, n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4.0) AS jb FROM m)
SELECT n, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(jb, 4) AS jb,
       round(exp(-jb / 2.0), 6) AS p_value, exp(-jb / 2.0) > 0.05 AS is_normal FROM j
""")
def g04_normality_revenue(spark, d):
    out = rnd(G.normality(sales(spark, d), "revenue"), "skewness", "kurtosis", "p_value")
    return out.withColumn("jb", F.round("jb", 4))


def _corr_sql(cols) -> str:
    parts = []
    for x, y in combinations(cols, 2):
        for a, b in ((x, y), (y, x)):
            parts.append(f"""SELECT '{a}' AS x, '{b}' AS y,
  round(CASE WHEN stddev_pop(CAST({x} AS DOUBLE)) > 0 AND stddev_pop(CAST({y} AS DOUBLE)) > 0
        THEN covar_pop(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) / (stddev_pop(CAST({x} AS DOUBLE)) * stddev_pop(CAST({y} AS DOUBLE))) END, 6) AS r,
  count(*) AS n FROM sales WHERE {x} IS NOT NULL AND {y} IS NOT NULL""")
    for x in cols:
        parts.append(f"""SELECT '{x}', '{x}', CASE WHEN stddev_pop(CAST({x} AS DOUBLE)) > 0 THEN 1.0 END, count({x}) FROM sales""")
    return "\nUNION ALL\n".join(parts)


@register("g05_correlation_matrix", _corr_sql(CORR_COLS))
def g05_correlation_matrix(spark, d):
    return rnd(G.correlation_matrix(sales(spark, d), CORR_COLS), "r")


_PEARSON_SQL = """
WITH a AS (SELECT covar_pop(CAST(discount AS DOUBLE), CAST(orders AS DOUBLE)) / (stddev_pop(CAST(discount AS DOUBLE)) * stddev_pop(CAST(orders AS DOUBLE))) AS r,
                  count(*) AS n FROM sales WHERE discount IS NOT NULL AND orders IS NOT NULL)
SELECT round(r, 6) AS r, n, n - 2 AS dof, round(CASE WHEN abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END, 6) AS t,
       CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' ELSE 'strong' END AS strength
FROM a
"""


@register("g06_pearson_discount_orders", _PEARSON_SQL)
def g06_pearson_discount_orders(spark, d):
    return rnd(G.pearson_test(sales(spark, d), "discount", "orders", with_p=False), "r", "t")


@register("g06_pearson_discount_orders_p")
def g06_pearson_discount_orders_p(spark, d):
    return G.pearson_test(sales(spark, d), "discount", "orders")


_TTEST_SQL = """
WITH a AS (SELECT count(CASE WHEN promo = 'Yes' THEN revenue END) AS n_a, avg(CASE WHEN promo = 'Yes' THEN CAST(revenue AS DOUBLE) END) AS mean_a,
                  var_samp(CASE WHEN promo = 'Yes' THEN CAST(revenue AS DOUBLE) END) AS var_a,
                  count(CASE WHEN promo = 'No' THEN revenue END) AS n_b, avg(CASE WHEN promo = 'No' THEN CAST(revenue AS DOUBLE) END) AS mean_b,
                  var_samp(CASE WHEN promo = 'No' THEN CAST(revenue AS DOUBLE) END) AS var_b FROM sales)
SELECT n_a, round(mean_a, 6) AS mean_a, round(var_a, 0) AS var_a, n_b, round(mean_b, 6) AS mean_b, round(var_b, 0) AS var_b,
       n_a + n_b - 2 AS dof,
       round(CASE WHEN n_a > 1 AND n_b > 1 THEN (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)) END, 6) AS t
FROM a
"""


@register("g07_ttest_revenue_by_promo", _TTEST_SQL)
def g07_ttest_revenue_by_promo(spark, d):
    out = rnd(G.two_sample_ttest(sales(spark, d), "promo", "revenue", with_p=False), "mean_a", "mean_b", "t")
    return out.withColumn("var_a", F.round("var_a", 0)).withColumn("var_b", F.round("var_b", 0))


@register("g07_ttest_revenue_by_promo_p")
def g07_ttest_revenue_by_promo_p(spark, d):
    return G.two_sample_ttest(sales(spark, d), "promo", "revenue")


def _box_sql(value: str, src: str = "sales", by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""
WITH b AS (SELECT {g}CAST({value} AS DOUBLE) AS v FROM {src} WHERE {value} IS NOT NULL {f"AND {by} IS NOT NULL" if by else ""}),
s AS (SELECT {g}count(v) AS n, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std, var_samp(v) AS variance,
             skewness(v) AS skew, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM b {grp}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM s),
o AS (SELECT {g}count(CASE WHEN b.v < f.lo_fence OR b.v > f.hi_fence THEN 1 END) AS outlier_count FROM b JOIN f {join} {grp})
SELECT {g}n, min, max, round(mean, 6) AS mean, round(CASE WHEN n > 1 THEN std ELSE 0 END, 6) AS std,
       round(CASE WHEN n > 1 THEN variance ELSE 0 END, 0) AS variance, round(coalesce(skew, 0), 6) AS skew,
       round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lo_fence, 6) AS lo_fence, round(hi_fence, 6) AS hi_fence, outlier_count,
       round(outlier_count * 100.0 / n, 6) AS outlier_pct
FROM f JOIN o {join}
"""


def _box_round(df):
    df = rnd(df, *[c for c in ("mean", "std", "skew", "q1", "median", "q3", "iqr", "lo_fence", "hi_fence",
                               "outlier_pct") if c in df.columns])
    return df.withColumn("variance", F.round("variance", 0))


@register("g08_boxplot_revenue", _box_sql("revenue"))
def g08_boxplot_revenue(spark, d):
    return _box_round(G.boxplot_stats(sales(spark, d), "revenue"))


@register("g09_iqr_outliers_price", """
WITH q AS (SELECT quantile_cont(current_price, 0.25) AS q1, quantile_cont(current_price, 0.75) AS q3 FROM sales)
SELECT order_id, product, city, current_price FROM sales, q
WHERE current_price < q1 - 1.5 * (q3 - q1) OR current_price > q3 + 1.5 * (q3 - q1)
""")
def g09_iqr_outliers_price(spark, d):
    s = sales(spark, d).select("order_id", "product", "city", "current_price")
    return G.iqr_outliers(s, "current_price")


@register("g10_most_variable_city", """
SELECT city, round(std, 6) AS std FROM (SELECT city, stddev_samp(CAST(revenue AS DOUBLE)) AS std FROM sales
WHERE city IS NOT NULL GROUP BY city) WHERE std IS NOT NULL ORDER BY std DESC, city LIMIT 1
""")
def g10_most_variable_city(spark, d):
    return rnd(G.most_variable_group(sales(spark, d), "city", "revenue"), "std")


@register("g11_grouped_boxplot_brand", _box_sql("revenue", src="""(SELECT * FROM sales WHERE brand IN (
  SELECT brand FROM sales WHERE brand IS NOT NULL GROUP BY brand ORDER BY count(revenue) DESC, brand LIMIT 15))""", by="brand"))
def g11_grouped_boxplot_brand(spark, d):
    return _box_round(G.grouped_boxplot(sales(spark, d), "brand", "revenue", 15))


@register("g12_histogram_revenue", """
WITH b AS (SELECT CAST(revenue AS DOUBLE) AS v FROM sales WHERE revenue IS NOT NULL),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM b),
c AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((v - lo) / ((hi - lo) / 20)) AS INTEGER), 19) END AS bin,
             count(*) AS count FROM b, r GROUP BY 1),
s AS (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS bin)
SELECT s.bin, lo + s.bin * ((hi - lo) / 20) AS bin_start,
       CASE WHEN s.bin = 19 THEN hi ELSE lo + (s.bin + 1) * ((hi - lo) / 20) END AS bin_end,
       coalesce(c.count, 0) AS count
FROM s CROSS JOIN r LEFT JOIN c ON s.bin = c.bin
""")
def g12_histogram_revenue(spark, d):
    return G.histogram(sales(spark, d), "revenue", 20)


@register("g13_numeric_distribution_price", """
WITH s AS (SELECT count(current_price) AS n, quantile_cont(current_price, 0.25) AS q1, quantile_cont(current_price, 0.5) AS median,
                  quantile_cont(current_price, 0.75) AS q3, coalesce(skewness(current_price), 0) AS skew FROM sales)
SELECT n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(skew, 6) AS skew,
       CASE WHEN abs(skew) < 0.5 THEN 'fairly symmetric' WHEN skew >= 0.5 THEN 'right-skewed' ELSE 'left-skewed' END AS shape,
       n >= 5 AS enough_data FROM s
""")
def g13_numeric_distribution_price(spark, d):
    return rnd(G.numeric_distribution(sales(spark, d), "current_price"), "q1", "median", "q3", "skew")


@register("g14_numeric_spread_discount", """
WITH s AS (SELECT count(discount) AS n, quantile_cont(CAST(discount AS DOUBLE), 0.25) AS q1,
                  quantile_cont(CAST(discount AS DOUBLE), 0.5) AS median, quantile_cont(CAST(discount AS DOUBLE), 0.75) AS q3 FROM sales)
SELECT n, median, q1, q3,
       (SELECT count(*) FROM sales WHERE discount < q1 - 1.5 * (q3 - q1) OR discount > q3 + 1.5 * (q3 - q1)) AS outlier_count,
       n >= 5 AS enough_data FROM s
""")
def g14_numeric_spread_discount(spark, d):
    return G.numeric_spread(sales(spark, d), "discount")


@register("g15_relationship_orders_revenue", """
WITH a AS (SELECT count(*) AS n, coalesce(covar_pop(CAST(orders AS DOUBLE), CAST(revenue AS DOUBLE))
        / (stddev_pop(CAST(orders AS DOUBLE)) * stddev_pop(CAST(revenue AS DOUBLE))), 0.0) AS r FROM sales
        WHERE orders IS NOT NULL AND revenue IS NOT NULL)
SELECT n, round(r, 6) AS r,
       CASE WHEN abs(r) < 0.15 THEN 'no clear' WHEN abs(r) < 0.35 THEN 'a weak' WHEN abs(r) < 0.6 THEN 'a moderate' ELSE 'a strong' END AS strength,
       CASE WHEN abs(r) < 0.15 THEN '' WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
       n >= 5 AS enough_data FROM a
""")
def g15_relationship_orders_revenue(spark, d):
    return rnd(G.relationship(sales(spark, d), "orders", "revenue"), "r")


PAIR_COLS = ["orders", "revenue", "profit", "discount", "current_price"]


@register("g16_strongest_pair", f"""
WITH c AS ({_corr_sql(PAIR_COLS)}),
o AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(PAIR_COLS))}) v(name, i))
SELECT x, y, r FROM c JOIN o ox ON c.x = ox.name JOIN o oy ON c.y = oy.name
WHERE x <> y AND r IS NOT NULL AND abs(r) > 0 ORDER BY abs(r) DESC, ox.i, oy.i LIMIT 1
""")
def g16_strongest_pair(spark, d):
    return rnd(G.strongest_pair(sales(spark, d), PAIR_COLS), "r")


@register("g17_top_brands_with_other", """
WITH g AS (SELECT brand, count(*) AS count FROM sales WHERE brand IS NOT NULL GROUP BY brand),
k AS (SELECT brand FROM g ORDER BY count DESC, brand LIMIT 5),
l AS (SELECT CASE WHEN g.brand IN (SELECT brand FROM k) OR (SELECT count(*) FROM g) <= 6 THEN g.brand ELSE 'Other' END AS brand,
             count FROM g)
SELECT brand, sum(count) AS count, sum(count) * 100.0 / (SELECT sum(count) FROM g) AS share_pct FROM l GROUP BY brand
""")
def g17_top_brands_with_other(spark, d):
    return G.top_categories_with_other(sales(spark, d), "brand", 6)


@register("e08_promo_stats", """
WITH a AS (SELECT CAST(sum(CASE WHEN promo = 'Yes' THEN revenue END) AS DOUBLE) / count(CASE WHEN promo = 'Yes' THEN revenue END) AS rev_y,
                  CAST(sum(CASE WHEN promo = 'No' THEN revenue END) AS DOUBLE) / count(CASE WHEN promo = 'No' THEN revenue END) AS rev_n,
                  CAST(sum(CASE WHEN promo = 'Yes' THEN orders END) AS DOUBLE) / count(CASE WHEN promo = 'Yes' THEN orders END) AS ord_y,
                  CAST(sum(CASE WHEN promo = 'No' THEN orders END) AS DOUBLE) / count(CASE WHEN promo = 'No' THEN orders END) AS ord_n,
                  count(CASE WHEN promo = 'Yes' THEN 1 END) AS count_y, count(CASE WHEN promo = 'No' THEN 1 END) AS count_n FROM sales)
SELECT coalesce(rev_y, 0.0) AS rev_y, coalesce(rev_n, 0.0) AS rev_n,
       CASE WHEN rev_n > 0 THEN (rev_y - rev_n) / rev_n * 100.0 ELSE 0.0 END AS rev_lift_pct,
       coalesce(ord_y, 0.0) AS ord_y, coalesce(ord_n, 0.0) AS ord_n,
       CASE WHEN ord_n > 0 THEN (ord_y - ord_n) / ord_n * 100.0 ELSE 0.0 END AS ord_lift_pct,
       count_y, count_n FROM a
""")
def e08_promo_stats(spark, d):
    return promo_stats(sales(spark, d), with_p=False)


@register("e08_promo_stats_p")
def e08_promo_stats_p(spark, d):
    return promo_stats(sales(spark, d))


@register("g02_zscore_outliers_price", """
WITH s AS (SELECT avg(current_price) mu, stddev_pop(current_price) sd FROM sales),
f AS (SELECT product, city, category, current_price, abs(current_price - s.mu) / s.sd AS z_score FROM sales, s
      WHERE abs(current_price - s.mu) / s.sd > 2)
SELECT product, city, category, current_price, round(z_score, 6) AS z_score, (SELECT count(*) FROM f) AS outlier_count
FROM f ORDER BY z_score DESC, product, city, category, current_price LIMIT 10
""")
def g02_zscore_outliers_price(spark, d):
    s = sales(spark, d).select("product", "city", "category", "current_price")
    return rnd(G.zscore_outliers(s, "current_price", 2.0, 10), "z_score")


@register("g03_top_anomaly_price", """
WITH s AS (SELECT avg(current_price) mu, stddev_pop(current_price) sd, count(*) n FROM sales),
r AS (SELECT product, city, category, current_price, abs(current_price - s.mu) / s.sd AS z, s.mu, s.n FROM sales, s)
SELECT product, city, category, current_price, round(z, 6) AS z,
       CASE WHEN current_price > mu THEN 'spike' ELSE 'drop' END AS direction
FROM r WHERE n >= 5 AND z >= 3 ORDER BY z DESC, product, city, category LIMIT 1
""")
def g03_top_anomaly_price(spark, d):
    return rnd(G.top_anomaly(sales(spark, d), "current_price", 3.0), "z")
