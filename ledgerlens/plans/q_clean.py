"""Registered queries for filters, paging and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import filters as B
from .catalog import register, rnd, table
from .sales_view import sales

# A "raw upload" derived from the sales view: text-typed numbers, the promo flag missing for
# the 'A' return flag (null group keys), as the reference's CSV path receives them.
RAW_SQL = """raw AS (SELECT product, category, city, CAST(original_price AS VARCHAR) AS original_price,
  CAST(current_price AS VARCHAR) AS current_price, CAST(discount AS VARCHAR) AS discount,
  CAST(orders AS VARCHAR) AS orders, CAST(revenue AS VARCHAR) AS revenue, promo FROM sales)"""


def raw_sales(spark, d):
    s = sales(spark, d)
    return s.select("product", "category", "city",
                    *[F.col(c).cast("string").alias(c) for c in ("original_price", "current_price", "discount",
                                                                  "orders", "revenue")], "promo")


@register("b01_filter_sales", """
SELECT order_id, product, CAST(revenue AS DOUBLE) AS revenue, discount FROM sales
WHERE city = 'NATION_3' AND category = 'SMALL' AND promo = 'Yes'
""")
def b01_filter_sales(spark, d):
    f = B.filter_sales(sales(spark, d), city="NATION_3", category="SMALL", promo="Yes", product="All")
    return f.select("order_id", "product", F.col("revenue").cast("double").alias("revenue"), "discount")


@register("b02_search_product", """
SELECT product, count(*) AS n FROM sales WHERE coalesce(regexp_matches(product, '(?i)GEAR|bolt'), false) GROUP BY product
""")
def b02_search_product(spark, d):
    return B.search_product(sales(spark, d), "GEAR|bolt").groupBy("product").agg(F.count(F.lit(1)).alias("n"))


@register("b03_search_any_text", """
SELECT city, count(*) AS n FROM sales
WHERE coalesce(regexp_matches(product, '(?i)nation_1[0-4]$'), false) OR coalesce(regexp_matches(category, '(?i)nation_1[0-4]$'), false)
   OR coalesce(regexp_matches(brand, '(?i)nation_1[0-4]$'), false) OR coalesce(regexp_matches(city, '(?i)nation_1[0-4]$'), false)
   OR coalesce(regexp_matches(region, '(?i)nation_1[0-4]$'), false) OR coalesce(regexp_matches(segment, '(?i)nation_1[0-4]$'), false)
   OR coalesce(regexp_matches(promo, '(?i)nation_1[0-4]$'), false)
GROUP BY city
""")
def b03_search_any_text(spark, d):
    return B.search_any_text(sales(spark, d), "nation_1[0-4]$").groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@register("b04_scatter_points", """
SELECT product AS name, orders, CAST(revenue AS DOUBLE) AS revenue, category FROM sales
""")
def b04_scatter_points(spark, d):
    return B.scatter_points(sales(spark, d))


@register("b05_filter_options", """
SELECT DISTINCT 'cities' AS kind, city AS value FROM sales WHERE city IS NOT NULL
UNION ALL SELECT DISTINCT 'categories', category FROM sales WHERE category IS NOT NULL
UNION ALL SELECT DISTINCT 'products', product FROM sales WHERE product IS NOT NULL
""")
def b05_filter_options(spark, d):
    return B.filter_options(sales(spark, d))


@register("b06_page", """
WITH p AS (SELECT order_id, product, CAST(revenue AS DOUBLE) AS revenue, orders, ship_date,
                  row_number() OVER (ORDER BY order_id, product, revenue, orders, ship_date) AS row_number FROM sales)
SELECT *, (SELECT count(*) FROM sales) AS total, CAST(ceil((SELECT count(*) FROM sales) / 25.0) AS BIGINT) AS pages
FROM p WHERE row_number > 50 AND row_number <= 75
""")
def b06_page(spark, d):
    s = sales(spark, d).select("order_id", "product", F.col("revenue").cast("double").alias("revenue"),
                               "orders", "ship_date")
    return B.page(s, 3, 25, ["order_id", "product", "revenue", "orders", "ship_date"])


@register("b08_drop_empty_rows", """
SELECT count(*) AS n FROM (SELECT * FROM sales WHERE promo IS NOT NULL)
""")
def b08_drop_empty_rows(spark, d):
    s = sales(spark, d)
    # rows whose promo flag is missing become entirely missing (derived dirty input)
    blanked = s.select(*[F.when(F.col("promo").isNotNull(), F.col(c)).alias(c) for c in s.columns])
    return B.drop_empty_rows(blanked).agg(F.count(F.lit(1)).alias("n"))


@register("b09_complete_rows", """
SELECT category, count(*) AS n FROM sales WHERE promo IS NOT NULL GROUP BY category
""")
def b09_complete_rows(spark, d):
    return B.complete_rows(sales(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register("c02_coerce_numeric", """
SELECT c_custkey, TRY_CAST(c_name AS DOUBLE) AS c_name, TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS acct
FROM customer
""", with_sales=False)
def c02_coerce_numeric(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("acct"))
    return C.coerce_numeric(c, ["c_name", "acct"])


@register("c03_impute_median", """
WITH s AS (SELECT CASE WHEN discount <> 0 THEN discount END AS discount FROM sales),
m AS (SELECT quantile_cont(discount, 0.5) AS med FROM s)
SELECT coalesce(CAST(discount AS INTEGER), CAST(med AS INTEGER)) AS discount, count(*) AS n FROM s, m GROUP BY 1
""")
def c03_impute_median(spark, d):
    s = sales(spark, d).select(F.when(F.col("discount") != 0, F.col("discount")).alias("discount"))
    return C.impute_median(s, ["discount"]).groupBy("discount").agg(F.count(F.lit(1)).alias("n"))


@register("c04_impute_mode", """
WITH m AS (SELECT promo AS mode FROM sales WHERE promo IS NOT NULL GROUP BY promo ORDER BY count(*) DESC, promo LIMIT 1)
SELECT trim(coalesce(promo, m.mode)) AS promo, count(*) AS n FROM sales, m GROUP BY 1
""")
def c04_impute_mode(spark, d):
    s = sales(spark, d).select("promo", "city")
    return C.impute_mode(s, ["promo", "city"]).groupBy("promo").agg(F.count(F.lit(1)).alias("n"))


@register("c05_c06_profit_margin", """
WITH r AS (SELECT category, (CAST(current_price AS DOUBLE) - CAST(original_price AS DOUBLE)) * CAST(orders AS DOUBLE) AS p,
                  CAST(revenue AS DOUBLE) AS rev FROM sales)
SELECT category, round(sum(p), 2) AS profit, round(avg(CASE WHEN rev > 0 THEN p / rev * 100.0 ELSE 0.0 END), 6) AS margin_pct
FROM r GROUP BY category
""")
def c05_c06_profit_margin(spark, d):
    s = C.add_margin(C.add_profit(sales(spark, d).drop("profit", "margin_pct")))
    g = s.groupBy("category").agg(F.round(F.sum("profit"), 2).alias("profit"), F.avg("margin_pct").alias("margin_pct"))
    return rnd(g, "margin_pct")


_ALIASES = {"nation_1": "Nation One", " NATION_2 ": "Nation Two", "nation_3": "NATION_3"}


@register("c08_alias_applied", """
SELECT DISTINCT city AS original, CASE lower(trim(city)) WHEN 'nation_1' THEN 'Nation One' WHEN 'nation_2' THEN 'Nation Two' END AS standardized
FROM sales WHERE lower(trim(city)) IN ('nation_1', 'nation_2')
""")
def c08_alias_applied(spark, d):
    return C.standardize_aliases(sales(spark, d), "city", _ALIASES)[1]


@register("c08_alias_counts", """
SELECT coalesce(CASE lower(trim(city)) WHEN 'nation_1' THEN 'Nation One' WHEN 'nation_2' THEN 'Nation Two'
                WHEN 'nation_3' THEN 'NATION_3' END, city) AS city, count(*) AS n FROM sales GROUP BY 1
""")
def c08_alias_counts(spark, d):
    out, _ = C.standardize_aliases(sales(spark, d), "city", _ALIASES)
    return out.groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@register("c09_dedupe", """
SELECT city, count(*) AS n FROM (SELECT DISTINCT product, city, discount FROM sales) GROUP BY city
""")
def c09_dedupe(spark, d):
    return C.dedupe(sales(spark, d).select("product", "city", "discount")).groupBy("city") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("c10_clean_sales", f"""
WITH {RAW_SQL},
n AS (SELECT product, category, city, TRY_CAST(original_price AS DOUBLE) AS original_price, TRY_CAST(current_price AS DOUBLE) AS current_price,
             TRY_CAST(discount AS DOUBLE) AS discount, TRY_CAST(orders AS DOUBLE) AS orders, TRY_CAST(revenue AS DOUBLE) AS revenue, promo FROM raw),
md AS (SELECT promo AS m FROM n WHERE promo IS NOT NULL GROUP BY promo ORDER BY count(*) DESC, promo LIMIT 1),
f AS (SELECT category, trim(coalesce(promo, md.m)) AS promo, current_price,
             (current_price - original_price) * orders AS profit, revenue FROM n, md),
t AS (SELECT *, CASE WHEN revenue > 0 THEN profit / revenue * 100.0 ELSE 0.0 END AS margin_pct,
             CASE WHEN current_price > 0 AND current_price <= 60 THEN '₹20–60' WHEN current_price > 60 AND current_price <= 100 THEN '₹61–100'
                  WHEN current_price > 100 AND current_price <= 140 THEN '₹101–140' WHEN current_price > 140 AND current_price <= 180 THEN '₹141–180'
                  WHEN current_price > 180 THEN '₹181+' END AS price_tier FROM f)
SELECT category, promo, price_tier, count(*) AS n, round(sum(profit), 2) AS profit, round(avg(margin_pct), 6) AS margin_pct
FROM t GROUP BY category, promo, price_tier
""")
def c10_clean_sales(spark, d):
    c = C.clean_sales(raw_sales(spark, d))
    g = c.groupBy("category", "promo", "price_tier").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("profit"), 2).alias("profit"), F.avg("margin_pct").alias("margin_pct"))
    return rnd(g, "margin_pct")


@register("c11_drop_empty_columns", """
SELECT count(*) AS n, 'category,city,revenue' AS columns FROM sales
""")
def c11_drop_empty_columns(spark, d):
    s = sales(spark, d).select("category", "city", F.lit(None).cast("string").alias("notes"),
                               "revenue", F.lit(float("nan")).alias("blank"))
    out = C.drop_empty_columns(s)
    return out.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(",".join(out.columns)))


def _dates_input(spark, d):
    o = table(spark, d, "orders")
    # three layouts derived from the order status; 'dd.MM.yyyy' is not a supported layout
    s = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")) \
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd MMM yyyy")) \
        .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return o.select("o_orderkey", s.alias("order_date"), F.col("o_orderstatus"))


@register("c12_standardize_dates_report", """
SELECT 'order_date' AS column, count(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 END) AS newly_null FROM orders
""", with_sales=False)
def c12_standardize_dates_report(spark, d):
    return C.standardize_dates(_dates_input(spark, d), ["order_date"])[1]


@register("c12_standardize_dates_years", """
SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN year(o_orderdate) END AS year, count(*) AS n FROM orders GROUP BY 1
""", with_sales=False)
def c12_standardize_dates_years(spark, d):
    out, _ = C.standardize_dates(_dates_input(spark, d), ["order_date"])
    return out.groupBy(F.year("order_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def _role_input(spark, d):
    s = sales(spark, d)
    return s.select("product", "city", F.when(F.col("discount") != 0, F.col("discount")).alias("discount"),
                    "promo", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))


ROLES = {"discount": "Measure", "promo": "Dimension", "city": "Dimension", "order_date": "Date", "product": "Identifier"}


@register("c13_clean_by_role_log", """
WITH p AS (SELECT product, city, CASE WHEN discount <> 0 THEN discount END AS discount, promo,
                  strftime(order_date, '%Y-%m-%d') AS order_date FROM sales),
d AS (SELECT DISTINCT * FROM p)
SELECT 'removed_duplicates' AS step, CAST(NULL AS VARCHAR) AS column, (SELECT count(*) FROM p) - (SELECT count(*) FROM d) AS count
WHERE (SELECT count(*) FROM p) > (SELECT count(*) FROM d)
UNION ALL SELECT 'imputed_median', 'discount', count(*) FROM d WHERE discount IS NULL HAVING count(*) > 0
UNION ALL SELECT 'filled_mode', 'promo', count(*) FROM d WHERE promo IS NULL HAVING count(*) > 0
""")
def c13_clean_by_role_log(spark, d):
    return C.clean_by_role(_role_input(spark, d), ROLES)[1]


@register("c13_clean_by_role_rows", """
WITH p AS (SELECT DISTINCT product, city, CASE WHEN discount <> 0 THEN discount END AS discount, promo,
                  strftime(order_date, '%Y-%m-%d') AS order_date FROM sales),
m AS (SELECT quantile_cont(discount, 0.5) AS med FROM p),
md AS (SELECT promo AS mode FROM p WHERE promo IS NOT NULL GROUP BY promo ORDER BY count(*) DESC, promo LIMIT 1)
SELECT coalesce(discount, CAST(med AS INTEGER)) AS discount, trim(coalesce(promo, md.mode)) AS promo, count(*) AS n
FROM p, m, md GROUP BY 1, 2
""")
def c13_clean_by_role_rows(spark, d):
    out, _ = C.clean_by_role(_role_input(spark, d), ROLES)
    return out.groupBy("discount", "promo").agg(F.count(F.lit(1)).alias("n"))


@register("c15_apply_fixes", """
WITH p AS (SELECT DISTINCT category, city, promo, discount FROM sales),
w AS (SELECT category AS t FROM p WHERE category IN ('ECONOMY', 'SMALL') GROUP BY category ORDER BY count(*) DESC, category LIMIT 1),
md AS (SELECT promo AS m FROM p WHERE promo IS NOT NULL GROUP BY promo ORDER BY count(*) DESC, promo LIMIT 1)
SELECT CASE WHEN category IN ('ECONOMY', 'SMALL') THEN w.t ELSE category END AS category, coalesce(promo, md.m) AS promo, count(*) AS n
FROM p, w, md GROUP BY 1, 2
""")
def c15_apply_fixes(spark, d):
    s = sales(spark, d).select("category", "city", "promo", "discount")
    out, _ = C.apply_fixes(s, {"dupes", "fill_missing", "cat_std::ECONOMY"},
                           similar_groups=[["ECONOMY", "SMALL"]])
    return out.groupBy("category", "promo").agg(F.count(F.lit(1)).alias("n"))


@register("c16_merge_similar_values", """
WITH w AS (SELECT category AS t FROM sales WHERE category IN ('LARGE', 'MEDIUM', 'SMALL') GROUP BY category
           ORDER BY count(*) DESC, category LIMIT 1)
SELECT CASE WHEN category IN ('LARGE', 'MEDIUM', 'SMALL') THEN w.t ELSE category END AS category, count(*) AS n
FROM sales, w GROUP BY 1
""")
def c16_merge_similar_values(spark, d):
    out = C.merge_similar_values(sales(spark, d), "category", ["LARGE", "MEDIUM", "SMALL"])
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register("c17_cleaning_summary", """
WITH p AS (SELECT product, city, promo, discount FROM sales)
SELECT (SELECT count(*) FROM p) AS rows_before, 4 AS cols_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS rows_after,
       (SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS duplicates, c.column, c.dtype, c.missing
FROM (SELECT 'product' AS column, 'string' AS dtype, count(*) FILTER (WHERE product IS NULL) AS missing FROM p
      UNION ALL SELECT 'city', 'string', count(*) FILTER (WHERE city IS NULL) FROM p
      UNION ALL SELECT 'promo', 'string', count(*) FILTER (WHERE promo IS NULL) FROM p
      UNION ALL SELECT 'discount', 'int', count(*) FILTER (WHERE discount IS NULL) FROM p) c
""")
def c17_cleaning_summary(spark, d):
    raw = sales(spark, d).select("product", "city", "promo", "discount")
    return C.cleaning_summary(raw, C.dedupe(raw))
