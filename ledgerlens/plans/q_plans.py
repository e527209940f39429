"""Registered queries for the orchestrators (I18, I19, D24), the legacy sales loader (A08) and
the formatting helpers (K01, K02, K05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import change_label, fmt_inr, fmt_pct
from ..operators.aggregate import revenue_by
from ..session import scratch_path
from ..sources import readers as R
from . import report as RP
from .catalog import register, table
from .sales_view import sales


def _sections(spark, tables):
    """(section, key, metric, value): every number of every section; the key is the row's other columns."""
    parts = []
    for name, df in tables.items():
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        others = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns if c not in numeric]
        values = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in numeric]
        values = values or [F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"))]
        long = df.select(F.concat_ws(" | ", *others).alias("key"), F.explode(F.array(*values)).alias("v"))
        parts.append(long.select(F.lit(name).alias("section"), "key", "v.metric", "v.value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("i18_eda_report")
def i18_eda_report(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _sections(spark, RP.eda_report(o.drop("o_custkey", "c_custkey")))


@register("i19_business_report")
def i19_business_report(spark, d):
    s = sales(spark, d).select(F.col("revenue").cast("double").alias("Total Revenue"),
                               F.col("profit").cast("double").alias("Profit"), F.col("orders").alias("Orders"),
                               F.col("order_date").alias("Order Date"), F.col("city").alias("City"),
                               F.col("category").alias("Category"), F.col("product").alias("Product Name"))
    return _sections(spark, RP.business_report(s))


@register("d24_run_engine")
def d24_run_engine(spark, d):
    from .q_profile import lake
    res = RP.run_engine(lake(spark, d))
    rows = [(n, t["quality"].first()["score"], len(t["roles"])) for n, t in res["tables"].items()]
    out = spark.createDataFrame(rows, "table string, score int, columns int")
    return out.withColumn("overall", F.lit(float(res["overall_score"]))) \
        .withColumn("best_domain", F.lit(res["best_domain"])).withColumn("ready", F.lit(bool(res["ready"]))) \
        .withColumn("total_rows", F.lit(res["rows"]).cast("long")) \
        .withColumn("domain_confidence", F.lit(res["domain_confidence"])) \
        .withColumn("recommended_sections", F.lit("; ".join(res["recommended_sections"])))


@register("a08_load_sales_roundtrip", """
SELECT category, count(*) AS n, round(sum(CAST(revenue AS DOUBLE)), 2) AS revenue,
       round(sum((current_price - CAST(original_price AS DOUBLE)) * orders), 2) AS profit
FROM sales GROUP BY category
""")
def a08_load_sales_roundtrip(spark, d):
    s = sales(spark, d)
    path = scratch_path(spark, "sales-upload") + ".csv"
    ref = s.select(F.col("product").alias("Product Name"), F.col("category").alias(" Category "),
                   F.col("city").alias("City"), F.col("original_price").alias("Original Price"),
                   F.col("current_price").alias("Current Price"), F.col("discount").alias("Discount"),
                   F.col("orders").alias("Orders"), F.col("revenue").alias("Total Revenue"),
                   F.col("promo").alias("Influencer Active"))
    ref.write.option("header", True).csv(path)
    clean = R.load_sales(spark, path, alias_map={})
    return clean.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"),
                                         F.round(F.sum("profit"), 2).alias("profit"))


@register("k01_k02_k05_labels", """
WITH g AS (SELECT city, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) * 100.0 / CAST(sum(revenue) AS DOUBLE) AS margin
           FROM sales WHERE city IS NOT NULL GROUP BY city),
t AS (SELECT avg(revenue) AS avg_rev FROM g)
SELECT city,
  CASE WHEN revenue >= 1e7 THEN '₹' || printf('%.1f', revenue / 1e7) || 'Cr' WHEN revenue >= 1e5 THEN '₹' || printf('%.2f', revenue / 1e5) || 'L'
       WHEN revenue >= 1e3 THEN '₹' || printf('%.1f', revenue / 1e3) || 'K' ELSE '₹' || printf('%,d', CAST(trunc(revenue) AS BIGINT)) END AS revenue_label,
  CASE WHEN margin >= 0 THEN '+' ELSE '' END || printf('%.1f', margin) || '%' AS margin_label,
  CASE WHEN avg_rev = 0 THEN '+0.0%' ELSE CASE WHEN (revenue - avg_rev) / abs(avg_rev) * 100 >= 0 THEN '↑' ELSE '↓' END
       || ' ' || printf('%.1f', abs((revenue - avg_rev) / abs(avg_rev) * 100)) || '% vs avg' END AS vs_avg_label
FROM g, t
""")
def k01_k02_k05_labels(spark, d):
    g = revenue_by(sales(spark, d), "city")
    m = sales(spark, d).groupBy("city").agg((F.sum("profit").cast("double") * 100.0 / F.sum("revenue").cast("double"))
                                            .alias("margin"))
    avg = g.agg(F.avg("revenue").alias("avg_rev"))
    j = g.join(m, "city").crossJoin(F.broadcast(avg))
    return j.select("city", fmt_inr(F.col("revenue")).alias("revenue_label"),
                    fmt_pct(F.col("margin"), signed=True).alias("margin_label"),
                    change_label(F.col("revenue"), F.col("avg_rev"), "vs avg").alias("vs_avg_label"))
