"""Inputs on which earlier versions crashed, lost rows or were wrong."""
from __future__ import annotations

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean, quantiles, semantics, similar, stats, timeseries
from ledgerlens.operators._common import positions
from ledgerlens.session import scratch_path
from ledgerlens.sources.registry import DatasetRegistry


def test_versions_stay_loadable_and_are_counted(spark):
    registry = DatasetRegistry(spark, scratch_path(spark, "reg-versions"))
    first = registry.save(spark.range(5), "numbers")
    registry.add_version(first, registry.load(first).filter("id < 2"), "v2")
    registry.add_version(first, registry.load(first).filter("id < 1"), "v3")
    assert [registry.load(first, v).count() for v in ("v1", "v2", "v3")] == [5, 2, 1]
    assert registry.load(first).count() == 1 and registry.list().first()["rows"] == 1
    with pytest.raises(KeyError):
        registry.load(first, "v9")


def test_time_table_after_a_period_without_revenue(spark):
    rows = [("2024-01-01", 10.0), ("2024-02-01", 0.0), ("2024-03-01", 5.0), ("2024-04-01", 10.0)]
    df = spark.createDataFrame([(d, v, 1.0, 1) for d, v in rows], "d string, revenue double, profit double, orders int")
    out = timeseries.time_table(df.withColumn("d", F.to_date("d")), "d").collect()
    assert [r.growth_pct for r in out] == [None, -100.0, None, 100.0]


@pytest.mark.parametrize("values", [[], [None, None]])
def test_box_statistics_of_nothing(spark, values):
    row = stats.boxplot_stats(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    assert row.n == 0 and row.outlier_pct == 0.0 and row.median is None


def test_median_of_integers_is_not_cut(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "a int, b int")
    out = clean.impute_median(df, ["a", "b"])
    assert dict(out.dtypes) == {"a": "double", "b": "int"}
    assert sorted(r.a for r in out.collect()) == [1.0, 1.5, 2.0]


def test_every_table_has_all_capabilities(spark):
    rows = [("t", 0, "d", "date", 0.9), ("t", 1, "r", "revenue", 0.9), ("t", 2, "x", "city", 0.3), ("none", 0, "q", "quantity", 0.2)]
    maps = spark.createDataFrame(rows, "table string, position int, original_name string, semantic_name string, confidence double")
    out = {(r.table, r.capability): r for r in semantics.evaluate_capabilities(maps).collect()}
    assert len(out) == 16 and not any(r.enabled for (t, _), r in out.items() if t == "none")
    assert out[("t", "forecasting")].via == "d + r" and out[("t", "revenue_kpis")].via == "r"
    assert out[("t", "hr_analysis")].lacking == "salary, employee_id, department"


@pytest.mark.parametrize("size", [69, 115, 138, 161])
def test_similar_spellings_at_the_ratio_itself(spark, size):
    rng = random.Random(size)
    base = "".join(rng.sample([chr(c) for c in range(0x4E00, 0x4E00 + 400)], size))
    for other in range(size - 30, size):
        if 2 * other / (size + other) >= 0.85:
            break
    pair = [base, base[:other]]
    assert difflib.SequenceMatcher(None, *pair).ratio() >= 0.85
    out = similar.similar_values(spark.createDataFrame([(v,) for v in pair], "v string"), "v").collect()
    assert len(out) == 1 and out[0].members == sorted(pair)


def test_quantiles_of_many_ties(spark):
    df = spark.range(20_000).select((F.col("id") % 11).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    probs = [0.05, 0.5, 0.95]
    rows = {r.p: r.value for r in quantiles.exact_quantiles(df, ["v"], probs).collect()}
    values = [i % 11 for i in range(20_000)]
    assert [rows[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)))
    by = {(r.g, r.p): r.value for r in quantiles.exact_quantiles(df, ["v"], probs, by="g").collect()}
    for g in range(3):
        assert [by[(g, p)] for p in probs] == pytest.approx(list(np.quantile([i % 11 for i in range(20_000) if i % 3 == g], probs)))


def test_ties_are_counted_before_they_are_shuffled(spark):
    counts = spark.range(20_000).select((F.col("id") % 11).alias("v")).groupBy("v").count()
    plan = positions(counts, [F.col("v")], running=("count",))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("_pid")[0]
