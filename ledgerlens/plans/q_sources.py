"""Registered queries for sources / sinks (A01-A13) and the streaming extra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import readers as R
from ..sources.json_arrays import write_json_arrays
from ..sources.registry import DatasetRegistry
from ..streaming import live as L
from .catalog import register, table
from .sales_view import read_table


@register("a01_csv_roundtrip", """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus
""", with_sales=False)
def a01_csv_roundtrip(spark, d):
    path = scratch_path(spark, "orders-csv")
    R.write_csv(table(spark, d, "orders"), path)
    back = R.read_delimited(spark, path)
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                             F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("a01_tsv_sniffed", """
SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment
""", with_sales=False)
def a01_tsv_sniffed(spark, d):
    path = scratch_path(spark, "customer-tab")
    table(spark, d, "customer").write.option("header", True).option("sep", "\t").csv(path)
    back = R.read_delimited(spark, path)  # separator sniffed from the first 4 KiB
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@register("a02_json_array_roundtrip", """
SELECT o_orderstatus, o_orderpriority AS "detail.priority", count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY 1, 2
""", with_sales=False)
def a02_json_array_roundtrip(spark, d):
    path = scratch_path(spark, "orders-json")
    write_json_arrays(table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.struct(F.col("o_orderpriority").alias("priority"), F.lit('{"]').alias("note")).alias("detail")), path)
    back = R.read_json(spark, path)
    return back.groupBy("o_orderstatus", "`detail.priority`").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@register("a03_jsonl_nested_roundtrip", """
SELECT c_mktsegment AS segment, c_nationkey AS "account.nation", count(*) AS n FROM customer GROUP BY 1, 2
""", with_sales=False)
def a03_jsonl_nested_roundtrip(spark, d):
    path = scratch_path(spark, "customer-jsonl")
    c = table(spark, d, "customer")
    c.select(F.col("c_mktsegment").alias("segment"),
             F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).alias("account")) \
        .write.json(path)
    back = R.read_jsonl(spark, path)
    return back.groupBy("segment", F.col("`account.nation`").cast("int").alias("account.nation")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("a04_xml_roundtrip", """
SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey
""", with_sales=False)
def a04_xml_roundtrip(spark, d):
    path = scratch_path(spark, "nation-xml")
    table(spark, d, "nation").write.format("xml").option("rootTag", "nations").option("rowTag", "nation").save(path)
    back = R.read_xml(spark, path, row_tag="nation")
    return back.groupBy(F.col("n_regionkey").cast("int").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"))


@register("a05_read_parquet", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1, 2
""", with_sales=False)
def a05_read_parquet(spark, d):
    li = R.read_parquet(spark, f"{d}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"),
                                                          F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@register("a06_load_dispatch", """
SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
""", with_sales=False)
def a06_load_dispatch(spark, d):
    region = R.load(spark, f"{d}/region.parquet").df
    nation = R.load(spark, f"{d}/nation.parquet").df
    return region.join(F.broadcast(nation), F.col("n_regionkey") == F.col("r_regionkey")) \
        .groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"))


@register("a07_classify_files")
def a07_classify_files(spark, d):
    return R.classify_files(spark, d).groupBy("extension", "category", "supported_now") \
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@register("a10_append_dataset", """
SELECT o_orderkey IS NULL AS k_null, o_totalprice IS NULL AS price_null, o_custkey IS NULL AS cust_null, count(*) AS n
FROM (SELECT o_orderkey, o_custkey, NULL AS o_totalprice FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderstatus = 'O') GROUP BY 1, 2, 3
""", with_sales=False)
def a10_append_dataset(spark, d):
    o = table(spark, d, "orders")
    base = o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
    new = o.filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")
    u = R.append_dataset(base, new)
    return u.groupBy(F.col("o_orderkey").isNull().alias("k_null"), F.col("o_totalprice").isNull().alias("price_null"),
                     F.col("o_custkey").isNull().alias("cust_null")).agg(F.count(F.lit(1)).alias("n"))


@register("a11_registry_roundtrip")
def a11_registry_roundtrip(spark, d):
    reg = DatasetRegistry(spark, scratch_path(spark, "registry"))
    seg = read_table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    first = reg.save(seg, "segments", source="customer", trust_score=100.0)
    second = reg.save(read_table(spark, d, "nation"), "nations", source="nation")
    reg.add_version(first, seg.filter(F.col("customers") > 0), "v2", "non-empty segments")
    reg.delete(second)
    listed = reg.list()
    return listed.join(reg.versions(first).groupBy("id").agg(F.count(F.lit(1)).alias("versions")), "id", "left") \
        .select("name", "source", "rows", "trust_score", "status", "versions")


@register("a12_export_filtered_csv", """
SELECT city, category, count(*) AS n, round(sum(revenue), 2) AS revenue FROM sales WHERE promo = 'Yes' GROUP BY 1, 2
""")
def a12_export_filtered_csv(spark, d):
    from ..operators.filters import filter_sales
    from .sales_view import sales
    chosen = filter_sales(sales(spark, d), promo="Yes").select("order_id", "city", "category", "revenue")
    back = R.read_delimited(spark, R.write_csv(chosen, scratch_path(spark, "filtered-csv"), compression="gzip"),
                            schema="order_id long, city string, category string, revenue decimal(38,6)")
    return back.groupBy("city", "category").agg(F.count(F.lit(1)).alias("n"),
                                                F.round(F.sum("revenue").cast("double"), 2).alias("revenue"))


@register("a13_export_report_tables")
def a13_export_report_tables(spark, d):
    from ..operators.aggregate import revenue_by
    from .sales_view import sales
    s = sales(spark, d)
    paths = R.export_report_tables({"Regional": revenue_by(s, "region"), "Categories": revenue_by(s, "category"),
                                    "Raw Data": s.select("order_id", "product", "revenue")},
                                   scratch_path(spark, "report-export"))
    parts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(n))
             for n, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("a13_export_contents", """
SELECT 'Regional' AS "table", region AS key, round(CAST(sum(revenue) AS DOUBLE), 2) AS revenue, 1 AS n
FROM sales WHERE region IS NOT NULL GROUP BY region
UNION ALL SELECT 'Categories', category, round(CAST(sum(revenue) AS DOUBLE), 2), 1 FROM sales WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT 'Raw Data', product, round(CAST(sum(revenue) AS DOUBLE), 2), count(*) FROM sales GROUP BY product
""")
def a13_export_contents(spark, d):
    """The exported tables read back: keys, sums and the whole raw data by product."""
    from ..operators.aggregate import revenue_by
    from .sales_view import sales
    s = sales(spark, d)
    paths = R.export_report_tables({"Regional": revenue_by(s, "region"), "Categories": revenue_by(s, "category"),
                                    "Raw Data": s.select("order_id", "product", "revenue")},
                                   scratch_path(spark, "report-export"))
    keys = {"Regional": "region", "Categories": "category", "Raw Data": "product"}
    parts = [spark.read.parquet(p).groupBy(F.lit(n).alias("table"), F.col(keys[n]).alias("key"))
             .agg(F.round(F.sum("revenue").cast("double"), 2).alias("revenue"), F.count(F.lit(1)).alias("n")) for n, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("s01_stream_windowed_kpis", """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
       count(*) AS events, round(sum(value), 4) AS value_sum, round(avg(value), 6) AS value_avg, max(value) AS value_max
FROM events GROUP BY 1, 2, 3
""", with_sales=False)
def s01_stream_windowed_kpis(spark, d):
    ev = read_table(spark, d, "events")
    stream = L.stream_parquet(spark, d, ev.schema, glob="events.parquet")
    hist = L.run_to_table(L.windowed_kpis(stream, "ts", "value", "event_type", "1 day", "1 hour"), "kpis",
                          output_mode="update")
    out = L.latest_per_key(hist, ["window_start", "window_end", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "events",
                      F.round("value_sum", 4).alias("value_sum"), F.round("value_avg", 6).alias("value_avg"),
                      "value_max")


@register("s02_stream_update_mode_sla", """
SELECT date_trunc('day', ts) AS window_start, count(*) AS n, round(avg(value), 6) AS avg,
       round(avg(CASE WHEN value <= 12.0 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS on_time_pct
FROM events GROUP BY 1
""", with_sales=False)
def s02_stream_update_mode_sla(spark, d):
    ev = read_table(spark, d, "events")
    stream = L.stream_parquet(spark, d, ev.schema, glob="events.parquet")
    hist = L.run_to_table(L.windowed_sla(stream, "ts", "value", 10.0, 2.0), "sla", output_mode="update")
    out = L.latest_per_key(hist, ["window_start"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n",
                      F.round("avg", 6).alias("avg"), F.round("on_time_pct", 6).alias("on_time_pct"))
