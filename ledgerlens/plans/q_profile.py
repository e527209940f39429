"""Registered queries for profiling, validation, quality and semantics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import quality as Q
from ..operators import semantics as S
from ..operators.similar import similar_values
from .catalog import register, rnd, table
from .sales_view import sales

# The driver tables as an "uploaded lake": table prefixes stripped and *key columns renamed to
# *_id (o_custkey -> cust_id), so shared key names line up across tables like real uploads.
LAKE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
# The driver tables' column names and Spark types (from the data contract).
LAKE_SCHEMA = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
}


def lake_name(col: str) -> str:
    base = re.sub(r"^[a-z]+_", "", col)
    return re.sub(r"key$", "_id", base)


def lake(spark, d):
    return {t: table(spark, d, t).select(*[F.col(c).alias(lake_name(c)) for c in table(spark, d, t).columns])
            for t in LAKE}


def _kind(t: str) -> str:
    return {"int": "numeric", "bigint": "numeric", "double": "numeric", "string": "text"}.get(t, "date")


def _catalogue_sql() -> str:
    parts = []
    for t, cols in LAKE_SCHEMA.items():
        for i, (c, ty) in enumerate(cols):
            num = _kind(ty) == "numeric"
            parts.append(f"""SELECT '{t}' AS "table", {i} AS position, '{lake_name(c)}' AS "column", '{ty}' AS dtype,
  '{_kind(ty)}' AS kind, count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique",
  {f"min(CAST({c} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"} AS min, {f"max(CAST({c} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"} AS max,
  {f"round(avg(CAST({c} AS DOUBLE)), 5)" if num else "CAST(NULL AS DOUBLE)"} AS mean,
  {f"count(CASE WHEN {c} < 0 THEN 1 END)" if num else "CAST(NULL AS BIGINT)"} AS negative_count FROM {t}""")
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT *, CASE WHEN rows = 0 THEN 0.0 ELSE missing * 100.0 / rows END AS missing_pct,
  "unique" <= 1 AS constant FROM ({body})"""


CATALOGUE_SQL = _catalogue_sql()


def _catalogue(spark, d):
    return P.column_catalogue(lake(spark, d))


@register("d02_column_catalogue", CATALOGUE_SQL, with_sales=False)
def d02_column_catalogue(spark, d):
    return rnd(_catalogue(spark, d), "mean", dp=5)


@register("d01_profile_table_orders", """
SELECT count(*) AS rows, 6 AS columns, 0 AS missing_total, 0.0 AS missing_pct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows,
       round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders))) * 100.0 / count(*), 2) AS duplicate_pct,
       'order_id,cust_id,totalprice' AS numeric_columns, 'orderstatus,orderpriority' AS categorical_columns,
       'orderdate' AS date_columns, 'order_id' AS id_columns
FROM orders
""", with_sales=False)
def d01_profile_table_orders(spark, d):
    o = lake(spark, d)["orders"]
    out = P.profile_table(o, "orders")
    return out.select(*[F.array_join(c, ",").alias(c) if c.endswith("_columns") else F.col(c) for c in out.columns])


def _roles(spark, d):
    tabs = lake(spark, d)
    dates = {t: P.detect_date_columns(df) for t, df in tabs.items()}
    return P.classify_roles(P.with_detections(P.decided_catalogue(tabs), dates))


_ROLE_SQL = f"""
WITH cat AS ({CATALOGUE_SQL}),
f AS (SELECT *, (lower("column") LIKE '%id%' OR lower("column") LIKE '%code%' OR lower("column") LIKE '%sku%' OR lower("column") LIKE '%uuid%')
                AND "unique" / greatest(rows, 1) > 0.9 AS is_id, kind = 'date' AS is_date FROM cat)
SELECT "table", "column", CASE WHEN is_id THEN 'Identifier' WHEN is_date THEN 'Date'
  WHEN kind = 'numeric' AND regexp_matches(lower("column"), 'revenue|sales|profit|cost|price|amount|orders|quantity|qty|margin|discount|rating|count|spend') THEN 'Measure'
  WHEN kind = 'numeric' AND rows >= 20 AND "unique" <= greatest(10, floor(rows * 0.02)) THEN 'Dimension'
  WHEN kind = 'numeric' THEN 'Measure'
  WHEN regexp_matches(lower("column"), 'category|region|city|product|segment|channel|store|brand|status|type|partner|influencer') THEN 'Dimension'
  WHEN "unique" / greatest(rows, 1) < 0.5 THEN 'Dimension' ELSE 'Unclassified' END AS role
FROM f
"""


@register("d04_detect_id_columns", f"""
WITH r AS ({_ROLE_SQL}) SELECT "table", "column" FROM r WHERE role = 'Identifier'
""", with_sales=False)
def d04_detect_id_columns(spark, d):
    return P.detect_id_columns(_catalogue(spark, d))


@register("d05_classify_roles", _ROLE_SQL, with_sales=False)
def d05_classify_roles(spark, d):
    return _roles(spark, d).select("table", "column", "role")


@register("d05_role_confidence", f"""
WITH r AS ({_ROLE_SQL}) SELECT "table", round(avg(CASE WHEN role <> 'Unclassified' THEN 1.0 ELSE 0.0 END), 2) AS confidence
FROM r GROUP BY "table"
""", with_sales=False)
def d05_role_confidence(spark, d):
    return P.role_confidence(_roles(spark, d))


def _text_dates(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date_text"),
                    F.col("o_orderpriority").alias("update_time_note"), "o_orderdate")


@register("d03_detect_date_columns")
def d03_detect_date_columns(spark, d):
    cols = P.detect_date_columns(_text_dates(spark, d))
    return spark.createDataFrame([(c,) for c in cols], "column string")


def _sem(spark, d):
    tabs = dict(lake(spark, d))
    tabs["sales"] = sales(spark, d)
    dates = {t: P.detect_date_columns(df) for t, df in tabs.items()}
    return S.map_semantics(P.with_detections(P.column_catalogue(tabs), dates))


@register("d07_map_semantics")
def d07_map_semantics(spark, d):
    return _sem(spark, d)


@register("d08_capabilities")
def d08_capabilities(spark, d):
    return S.evaluate_capabilities(_sem(spark, d))


def _names_sql(tables: dict[str, list[str]]) -> str:
    """The column names of some tables as rows (table, position, column)."""
    rows = ", ".join(f"('{t}', {i}, '{c}')" for t, cols in tables.items() for i, c in enumerate(cols))
    return f"""(SELECT * FROM (VALUES {rows}) v("table", position, "column"))"""


def _domain_sql() -> str:
    names = _names_sql({t: [lake_name(c) for c, _ in cols] for t, cols in LAKE_SCHEMA.items()})
    words = ", ".join(f"({i}, '{d}', '{k}', {weight})" for i, (d, (strong, own)) in enumerate(S.DOMAIN_SIGNATURES.items())
                      for weight, keys in ((2, strong), (1, own)) for k in keys)
    return f"""
WITH names AS (SELECT "table", string_agg(lower("column"), ' ' ORDER BY position) AS cols FROM {names} GROUP BY "table"
               UNION ALL SELECT 'sales', lower(array_to_string([column_name FOR column_name IN (
                   SELECT list(column_name) FROM (DESCRIBE sales))], ' '))),
words AS (SELECT * FROM (VALUES {words}) v(di, domain, word, weight)),
scores AS (SELECT "table", di, domain, sum(CASE WHEN contains(cols, word) THEN weight ELSE 0 END) * 1.0::DOUBLE / sum(weight) AS score
           FROM names, words GROUP BY "table", di, domain),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY score DESC, di) = 1)
SELECT "table", CASE WHEN score > 0 AND score >= {S.DOMAIN_MIN_CONFIDENCE} THEN domain ELSE 'general_business' END AS domain,
       round_even(least(score, 1.0), 2) AS confidence FROM best"""


@register("d09_detect_domain", _domain_sql())
def d09_detect_domain(spark, d):
    tabs = dict(lake(spark, d))
    tabs["sales"] = sales(spark, d)
    return S.detect_domain(P.column_catalogue(tabs))


def _reference_named(spark, d):
    s = sales(spark, d)
    return s.select(F.col("product").alias("Product Name"), F.col("category").alias("Category"),
                    F.col("city").alias("City"), F.col("original_price").cast("double").alias("Original Price"),
                    F.col("current_price").alias("Current Price"), F.col("discount").alias("Discount"),
                    F.col("orders").alias("Orders"), F.col("revenue").cast("double").alias("Total Revenue"),
                    F.col("promo").alias("Influencer Active"), F.col("order_date").alias("Order Date"))


_REF_ROLES = {"Product Name": "Dimension", "Category": "Dimension", "City": "Dimension", "Original Price": "Measure",
              "Current Price": "Measure", "Discount": "Measure", "Orders": "Measure", "Total Revenue": "Measure",
              "Influencer Active": "Dimension", "Order Date": "Date"}


@register("d10_validate")
def d10_validate(spark, d):
    return Q.validate(_reference_named(spark, d), _REF_ROLES, "sales")


@register("d11_similar_values")
def d11_similar_values(spark, d):
    p = table(spark, d, "part")
    return similar_values(p, ["p_brand", "p_name", "p_type"], 0.85, 4)


@register("d12_quality_score")
def d12_quality_score(spark, d):
    df = _reference_named(spark, d)
    prof = P.profile_table(df, "sales", date_columns=["Order Date"])
    return Q.quality_score(prof, Q.validate(df, _REF_ROLES, "sales"))


@register("d13_quality_findings")
def d13_quality_findings(spark, d):
    return Q.quality_findings(_reference_named(spark, d))


@register("d14_trust_score")
def d14_trust_score(spark, d):
    df = _reference_named(spark, d)
    comp = Q.compatibility(df.columns)
    return Q.trust_score(Q.quality_findings(df), comp["can_import"], comp["required_missing"])


def _compatibility_sql() -> str:
    optional = Q.OPTIONAL_DELIVERY_COLS + Q.OPTIONAL_OPERATIONS_COLS + ["Influencer Active"]
    expected = ", ".join(f"('{c}', '{kind}', {start + i})" for kind, start, cols in (
        ("required", 0, Q.REQUIRED_COLUMNS), ("optional", 100, optional)) for i, c in enumerate(cols))
    return f"""
WITH names AS (SELECT "table", "column" FROM {_names_sql({"sales_reference": list(_REF_ROLES)})}
               UNION ALL SELECT 'sales', unnest((SELECT list(column_name) FROM (DESCRIBE sales)))),
tables AS (SELECT DISTINCT "table" FROM names), expected AS (SELECT * FROM (VALUES {expected}) v(expected, kind, ord)),
grid AS (SELECT t."table", e.*, EXISTS (SELECT 1 FROM names n WHERE n."table" = t."table" AND n."column" = e.expected) AS detected
         FROM tables t, expected e)
SELECT *, min(CASE WHEN kind = 'required' THEN detected::INTEGER END) OVER (PARTITION BY "table") = 1 AS can_import FROM grid"""


@register("d15_compatibility", _compatibility_sql())
def d15_compatibility(spark, d):
    tabs = {"sales_reference": _reference_named(spark, d), "sales": sales(spark, d)}
    return Q.compatibility_table(P.column_catalogue(tabs))


@register("d16_suggest_column_mapping")
def d16_suggest_column_mapping(spark, d):
    return S.suggest_column_mapping(P.column_catalogue({"sales": sales(spark, d)}))


@register("d17_data_quality_report", """
WITH p AS (SELECT CASE WHEN discount <> 0 THEN discount END AS discount, promo, city FROM sales)
SELECT 'promo' AS "column", 'string' AS dtype, count(*) - count(promo) AS missing, count(*) AS total_rows, 3 AS total_cols,
       (SELECT count(*) - count(promo) + count(*) - count(discount) FROM p) AS missing_total,
       (SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS dup_rows FROM p
UNION ALL
SELECT 'discount', 'int', count(*) - count(discount), count(*), 3,
       (SELECT count(*) - count(promo) + count(*) - count(discount) FROM p),
       (SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) FROM p
""")
def d17_data_quality_report(spark, d):
    s = sales(spark, d).select(F.when(F.col("discount") != 0, F.col("discount")).alias("discount"), "promo", "city")
    return P.data_quality_report(s, "sales")


@register("d18_report_quality", """
WITH p AS (SELECT CASE WHEN discount <> 0 THEN discount END AS discount, promo, city, current_price FROM sales),
a AS (SELECT count(*) AS rows, (count(*) - count(discount)) + (count(*) - count(promo)) AS missing,
             (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS d FROM p)
SELECT CAST(round(greatest(0, least(100, ((1 - missing / (rows * 4.0)) * 0.45 + (1 - (rows - d) / rows) * 0.30 + 1.0 * 0.25) * 100))) AS INTEGER) AS score,
       rows AS total_records, 4 AS total_columns, round(missing * 100.0 / (rows * 4), 6) AS missing_pct, rows - d AS duplicate_rows,
       round((rows - d) * 100.0 / rows, 6) AS duplicate_pct, 1.0 AS numeric_validity, missing = 0 AS no_missing,
       rows = d AS no_duplicates, true AS numeric_ok FROM a
""")
def d18_report_quality(spark, d):
    s = sales(spark, d).select(F.when(F.col("discount") != 0, F.col("discount")).alias("discount"), "promo", "city",
                               "current_price")
    return rnd(P.report_quality(s), "missing_pct", "duplicate_pct")


def _relationships_sql() -> str:
    """Every pair of tables with a column name in common whose first table has it as identifier."""
    named = {t: {lake_name(c): c for c, _ in cols} for t, cols in LAKE_SCHEMA.items()}
    pairs = [(a, b, c) for i, a in enumerate(LAKE) for b in LAKE[i + 1:] for c in sorted(named[a].keys() & named[b].keys())]
    parts = [f"""SELECT '{a}' AS table_a, '{c}' AS column_a, '{b}' AS table_b, '{c}' AS column_b, 'foreign_key_candidate' AS type,
  (SELECT count(DISTINCT {named[a][c]}) FROM {a}) AS distinct_a,
  (SELECT count(DISTINCT {named[a][c]}) FROM {a} WHERE {named[a][c]} IN (SELECT {named[b][c]} FROM {b})) AS matched
WHERE EXISTS (SELECT 1 FROM roles WHERE "table" = '{a}' AND "column" = '{c}' AND role = 'Identifier')""" for a, b, c in pairs]
    body = "\nUNION ALL\n".join(parts)
    return f"""WITH roles AS ({_ROLE_SQL}), found AS ({body})
SELECT *, CASE WHEN distinct_a > 0 THEN matched * 1.0 / distinct_a END AS overlap FROM found"""


@register("d19_discover_relationships", _relationships_sql(), with_sales=False)
def d19_discover_relationships(spark, d):
    tabs = lake(spark, d)
    dates = {t: P.detect_date_columns(df) for t, df in tabs.items()}
    roles = P.classify_roles(P.with_detections(P.decided_catalogue(tabs), dates))
    return P.discover_relationships(tabs, roles)


@register("d20_detect_report_schema")
def d20_detect_report_schema(spark, d):
    sch = S.detect_report_schema(_reference_named(spark, d))
    rows = [(k, v) for k, v in sch["concepts"].items()] + [("financial_extra", c) for c in sch["financial_extra"]] \
        + [("dimension_extra", c) for c in sch["dimension_extra"]]
    return spark.createDataFrame(rows, "concept string, column string")


@register("d21_detect_date_column")
def d21_detect_date_column(spark, d):
    c = S.detect_date_column(_text_dates(spark, d))
    return spark.createDataFrame([(c,)], "column string")


@register("d22_plan_eda")
def d22_plan_eda(spark, d):
    plan = S.plan_eda(table(spark, d, "orders").join(table(spark, d, "customer"),
                                                      F.col("o_custkey") == F.col("c_custkey")))
    rows = [("target", plan["target_col"])] + [("categorical", c) for c in plan["categorical_cols"]] \
        + [("numeric", c) for c in plan["numeric_cols"]]
    return spark.createDataFrame(rows, "kind string, column string")


@register("d23_derived_metrics", """
SELECT 'total_revenue' AS metric, round(sum(CAST(revenue AS DOUBLE)), 2) AS value, 'SUM(revenue)' AS formula FROM sales
UNION ALL SELECT 'profit', round(sum(CAST(profit AS DOUBLE)), 2), 'SUM(profit)' FROM sales
UNION ALL SELECT 'profit_margin_pct', round(sum(CAST(profit AS DOUBLE)) / sum(CAST(revenue AS DOUBLE)) * 100, 6), 'Profit / Total Revenue x 100' FROM sales
UNION ALL SELECT 'total_orders', sum(CAST(orders AS DOUBLE)), 'SUM(orders)' FROM sales
UNION ALL SELECT 'average_order_value', round(sum(CAST(revenue AS DOUBLE)) / sum(CAST(orders AS DOUBLE)), 6), 'SUM(revenue) / SUM(orders)' FROM sales
""")
def d23_derived_metrics(spark, d):
    out = P.derived_metrics(sales(spark, d).select("revenue", "profit", "orders", "city"))
    return out.withColumn("value", F.when(F.col("metric").isin("total_revenue", "profit"), F.round("value", 2))
                          .when(F.col("metric") == "total_orders", F.col("value")).otherwise(F.round("value", 6)))


@register("k09_suggest_fixes")
def k09_suggest_fixes(spark, d):
    ref = _reference_named(spark, d)
    return Q.suggest_fixes(Q.quality_findings(ref), {"Product": "Product Name"})


@register("k11_distribution_columns")
def k11_distribution_columns(spark, d):
    from ..operators.stats import group_columns, numeric_columns
    ref = _reference_named(spark, d)
    rows = [("numeric", c) for c in numeric_columns(ref)] + [("group", c) for c in group_columns(ref)]
    return spark.createDataFrame(rows, "kind string, column string")
