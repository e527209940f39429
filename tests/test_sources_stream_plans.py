"""Readers / writers round trips, registry, streaming = batch, distributed positions and plan
shape checks (scan counts, pushed filters)."""
from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators import aggregate as A
from ledgerlens.operators import filters as B
from ledgerlens.operators._common import positions
from ledgerlens.plans.sales_view import sales
from ledgerlens.session import scratch_path
from ledgerlens.sources import readers as R
from ledgerlens.sources.registry import DatasetRegistry
from ledgerlens.streaming import live as L


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_delimited_sniffing(spark, tmp_path):
    tab = _write(str(tmp_path / "a.csv"), "a\tb\n1\t2\n3\t4\n")
    assert R.read_delimited(spark, tab).columns == ["a", "b"]
    comma = _write(str(tmp_path / "b.csv"), "a,b\n1,2\n")
    assert R.read_delimited(spark, comma).first()["b"] == 2
    empty = _write(str(tmp_path / "c.csv"), "a,b\n")
    with pytest.raises(R.EmptyDatasetError):
        R.read_delimited(spark, empty)


def test_json_shapes(spark, tmp_path):
    obj = _write(str(tmp_path / "o.json"), json.dumps({"meta": 1, "data": [{"id": 1, "a": {"b": 2}, "tags": ["x"]},
                                                                       {"id": 2, "a": {"b": 3}, "tags": []}]}))
    df = R.read_json(spark, obj)
    assert sorted(df.columns) == ["a.b", "id", "tags"] and df.count() == 2
    arr = _write(str(tmp_path / "arr.json"), json.dumps([{"x": 1}, {"x": 2}, {"x": 3}]))
    assert R.read_json(spark, arr).count() == 3
    single = _write(str(tmp_path / "s.json"), json.dumps({"x": 1, "y": {"z": "q"}}))
    assert R.read_json(spark, single).columns == ["x", "y.z"]
    lines = _write(str(tmp_path / "l.jsonl"), '{"a": 1}\n\n{"a": 2, "b": {"c": true}}\n')
    assert R.read_jsonl(spark, lines).count() == 2


def test_xml_rows(spark, tmp_path):
    x = _write(str(tmp_path / "r.xml"), "<?xml version='1.0'?><rows><row><a>1</a></row><row><a>2</a></row></rows>")
    assert sorted(r["a"] for r in R.read_xml(spark, x).collect()) == [1, 2]


def test_load_dispatch_and_classify(spark, tmp_path):
    with pytest.raises(R.UnsupportedFormatError):
        R.load(spark, str(tmp_path / "deck.pptx"))
    assert R.classify("report.PDF")["category"] == "document"
    cls = R.classify_files(spark, SF_SMALL).groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in cls} == {"structured": 14}


def test_append_export_registry(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 3.0)], "id int, c double")
    u = R.append_dataset(a, b)
    assert u.columns == ["id", "a", "c"] and u.count() == 2
    reg = DatasetRegistry(spark, scratch_path(spark, "reg-test"))
    i1 = reg.save(a, "first")
    reg.save(b, "second")
    reg.delete(i1)
    names = [r["name"] for r in reg.list().collect()]
    assert names == ["second"]
    paths = R.export_report_tables({"KPI Summary": a, "Raw Data": u}, scratch_path(spark, "exp"), fmt="csv")
    assert spark.read.option("header", True).csv(paths["Raw Data"]).count() == 2


def test_stream_equals_batch(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    stream = L.stream_parquet(spark, SF_SMALL, ev.schema, glob="events.parquet")
    out = L.run_to_table(L.windowed_kpis(stream), "t", output_mode="complete")
    batch = ev.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["window_start"].date(), r["event_type"]): r["events"] for r in out.collect()}
    exp = {(r["d"].date(), r["event_type"]): r["n"] for r in batch.collect()}
    assert got == exp


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_positions_distributed_equals_row_number(spark, parts):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id").alias("k")) \
        .repartition(parts)
    got = positions(df, [F.col("v").desc(), F.col("k")], running=("v",))
    w = Window.orderBy(F.col("v").desc(), F.col("k"))
    exp = df.withColumn("rn", F.row_number().over(w)).withColumn(
        "cs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = sorted((r["k"], r["position"], r["cum_v"]) for r in got.collect())
    b = sorted((r["k"], r["rn"], r["cs"]) for r in exp.collect())
    assert a == b


@pytest.mark.parametrize("n", [1, 4, 200])
def test_results_independent_of_shuffle_partitions(spark, n):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        s = sales(spark, SF_SMALL)
        got = [tuple(r) for r in A.context_bundle(s).orderBy("grouping", "key").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    s = sales(spark, SF_SMALL)
    base = [tuple(r) for r in A.context_bundle(s).orderBy("grouping", "key").collect()]
    assert [x[:6] for x in got] == [x[:6] for x in base]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_context_bundle_is_one_scan(spark):
    s = sales(spark, SF_SMALL)
    plan = _plan(A.context_bundle(s))
    assert plan.count("FileScan parquet") == 1 and "Expand" in plan


def test_context_totals_hold_distinct_counts_and_lifts(spark, duck):
    from ledgerlens.plans.catalog import REGISTRY
    build, sql = REGISTRY["e19_context_totals"]
    got, want = tuple(build(spark, SF_SMALL).first()), duck.execute(sql).fetchone()
    assert got == pytest.approx(want, abs=1e-6) and min(got[:3]) > 1


def test_engine_query_takes_every_table(spark, monkeypatch):
    from ledgerlens.plans import q_plans, q_profile
    taken = {}

    def engine(tables):
        taken.update(tables)
        return dict(tables={}, overall_score=0, best_domain="x", ready=False, rows=0, domain_confidence=0.0,
                    recommended_sections=[])

    monkeypatch.setattr(q_plans.RP, "run_engine", engine)
    q_plans.d24_run_engine(spark, SF_SMALL)
    assert sorted(taken) == sorted(q_profile.LAKE)


def test_validation_lists_its_issues(spark):
    from ledgerlens.plans import report
    quality = spark.createDataFrame([(3,)], "total_records long")
    kpis = spark.createDataFrame([("revenue", float("nan"), 1.0), ("orders", 2.0, None)], "metric string, current double, previous double")
    ranks = spark.createDataFrame([("regions", "a")], "ranking string, key string")
    trend = spark.createDataFrame([(1, 2.0)], "month int, value double")
    out = report.validate_metrics(dict(kpis=kpis, rankings=ranks, trend=trend, quality=quality), ("regions", "top_products"))
    assert sorted(out) == ["issues", "kpis", "quality", "rankings"]
    assert [tuple(r) for r in out["issues"].collect()] == [
        ("warning", "kpi_not_finite", "revenue"), ("info", "ranking_empty", "top_products"), ("info", "trend_short", None)]
    payload = json.loads(report.metrics_payload(out | {"raw": trend}))
    assert sorted(payload) == ["issues", "kpis", "quality", "rankings"] and payload["kpis"][1]["previous"] is None
    assert {r.metric: r.current for r in out["kpis"].collect()} == {"revenue": 0.0, "orders": 2.0}
    empty = spark.createDataFrame([], "Revenue double, City string")
    assert [tuple(r) for r in report.business_report(empty)["issues"].collect()] == [("error", "no_rows", None)]


def test_engine_result_and_long_form_sections(spark):
    from ledgerlens.plans import q_plans, report
    table = spark.createDataFrame([(float(i), "x", i % 3) for i in range(12)], "revenue double, delivery_zone string, stock int")
    res = report.run_engine({"sales": table})
    assert res["rows"] == 12 and 0 <= res["domain_confidence"] <= 1
    assert res["recommended_sections"][:2] == ["Executive Overview", "Data Explorer"]
    assert {"Delivery Analytics", "Inventory Intelligence", "Finance"} <= set(res["recommended_sections"])
    long = q_plans._sections(spark, {"a": table.limit(1), "b": table.limit(1).select("delivery_zone")}).collect()
    assert {tuple(r) for r in long} == {("a", "x", "revenue", 0.0), ("a", "x", "stock", 0.0), ("b", "x", None, None)}


def test_filters_reach_the_scan(spark):
    s = sales(spark, SF_SMALL)
    plan = _plan(B.filter_sales(s, city="NATION_3", category="SMALL").select("revenue"))
    assert "PushedFilters: [IsNotNull(city), IsNotNull(category), EqualTo(city,NATION_3), EqualTo(category,SMALL)]" in plan
    assert "ReadSchema: struct<category:string,city:string,revenue:decimal(12,2)>" in plan


def _final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    final = text.split("+- == Initial Plan ==")[0] if "Initial Plan" in text else text
    return final


def test_correlation_matrix_one_aggregation(spark):
    from ledgerlens.operators import stats as G
    s = sales(spark, SF_SMALL)
    plan = _final_plan(G.correlation_matrix(s, ["revenue", "orders", "discount", "current_price"]))
    assert plan.count("FileScan parquet") == 1 and plan.count("HashAggregate") == 2


def test_catalogue_scans_without_expanding(spark):
    from ledgerlens.operators import profile as P
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    plan = _final_plan(P.column_catalogue({"orders": o}))
    assert plan.count("FileScan parquet") == 1 + len(o.columns) and "Expand" not in plan  # a pruned scan per column
    plan = _final_plan(P._table_catalogue("orders", o, True))
    assert plan.count("FileScan parquet") == 1 and "Expand" not in plan


def test_stream_counts_users_and_drops_closed_windows(spark, tmp_path):
    """Users of a window by a mergeable sketch over several batches; append mode emits closed windows only."""
    from ledgerlens.streaming import live
    rows = spark.range(3000).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value"),
                                    (F.col("id") % 500).alias("user_id"))
    for day in range(3):  # files in the order of their times
        rows.filter(F.floor(F.unix_timestamp("ts") / 86400) == day).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.stream_parquet(spark, str(tmp_path / "in"), rows.schema, max_files_per_trigger=1)
    kpis = live.windowed_kpis(stream, "ts", "value", None, "1 day", "1 hour", user="user_id")
    latest = live.latest_per_key(live.run_to_table(kpis, "users"), ["window_start", "window_end"]).orderBy("window_start").collect()
    assert [r.events for r in latest] == [1440, 1440, 120]
    assert all(abs(r.users - n) <= 0.1 * n for r, n in zip(latest, (500, 500, 120)))
    closed = live.run_to_table(kpis, "closed", output_mode="append").orderBy("window_start").collect()
    assert [r.events for r in closed] == [1440, 1440]
