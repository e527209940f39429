from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.pvalues import betainc_reg, t_two_sided_p
from ledgerlens.operators import stats as G
from ledgerlens.operators.quantiles import _pick, exact_quantiles


def test_t_pvalue_known_values():
    # two-sided p of Student's t; reference values from the closed forms for 1 and 2 dof
    for t in (0.5, 1.0, 2.5, 7.0):
        assert t_two_sided_p(t, 1.0) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-10)
        assert t_two_sided_p(t, 2.0) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)
    assert betainc_reg(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-4)
    assert t_two_sided_p(0.0, 10.0) == pytest.approx(1.0)


def test_pvalues_match_linear_regression(spark):
    """T8 cross-check: Pearson p (x -> y) and pooled t-test p (indicator -> y) equal the
    coefficient p-values of an ordinary least squares fit."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rnd = random.Random(7)
    data = [(float(rnd.randint(0, 10)), float(rnd.gauss(20, 5)), "Yes" if rnd.random() < .4 else "No")
            for _ in range(400)]
    df = spark.createDataFrame(data, "x double, y double, g string")
    df = df.withColumn("y", F.col("y") + 0.3 * F.col("x"))
    p_pearson = G.pearson_test(df, "x", "y").first()["p_value"]
    lr = LinearRegression(featuresCol="f", labelCol="y", solver="normal")
    m = lr.fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(df))
    assert p_pearson == pytest.approx(m.summary.pValues[0], rel=1e-6)
    p_t = G.two_sample_ttest(df, "g", "y").first()["p_value"]
    ind = df.withColumn("ind", (F.col("g") == "Yes").cast("double"))
    m2 = lr.fit(VectorAssembler(inputCols=["ind"], outputCol="f").transform(ind))
    assert p_t == pytest.approx(m2.summary.pValues[0], rel=1e-6)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_exact_quantiles_match_numpy(spark, parts):
    rnd = random.Random(parts)
    vals = [float(rnd.choice([1, 2, 2, 3, 5, 8, 13])) + (rnd.random() if rnd.random() < .5 else 0) for _ in range(3001)]
    groups = ["a" if i % 3 else "b" for i in range(len(vals))]
    df = spark.createDataFrame(list(zip(vals, groups)), "v double, g string").repartition(parts)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["p"]): r["value"] for r in exact_quantiles(df, ["v"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)
    by = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, ["v"], probs, by="g").collect()}
    for g in ("a", "b"):
        sub = [v for v, gg in zip(vals, groups) if gg == g]
        for p in probs:
            assert by[(g, p)] == pytest.approx(float(np.quantile(sub, p)), abs=1e-12)


def test_exact_pick_fallback_path(spark):
    """The full-sort path used when a sketch bracket misses gives the same answer."""
    vals = [float(x) for x in [9, 1, 4, 4, 7, 2, 8]]
    rows = spark.createDataFrame([("v", 0.5, v) for v in vals], "k string, p double, v double").groupBy(
        "k", "p", "v").agg(F.count("*").alias("c"))
    h = (len(vals) - 1) * 0.5
    tgt = spark.createDataFrame([("v", 0.5, int(math.floor(h)), int(math.ceil(h)), h - math.floor(h))],
                                "k string, p double, lo long, hi long, frac double")
    assert _pick(rows, tgt, ["k", "p"]).first()["value"] == float(np.quantile(vals, 0.5))


def test_describe_and_box_stats(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 50.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    d = G.describe_measure(df, "x").first()
    a = np.array(vals)
    assert d["std"] == pytest.approx(a.std())
    m2 = ((a - a.mean()) ** 2).mean()
    assert d["skewness"] == pytest.approx(((a - a.mean()) ** 3).mean() / m2 ** 1.5)
    b = G.boxplot_stats(df, "x").first()
    q1, q3 = np.quantile(a, [.25, .75])
    assert b["iqr"] == pytest.approx(q3 - q1)
    assert b["outlier_count"] == int(((a < q1 - 1.5 * (q3 - q1)) | (a > q3 + 1.5 * (q3 - q1))).sum())
    n = len(a)
    g1 = ((a - a.mean()) ** 3).mean() / m2 ** 1.5
    assert b["skew"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))


def test_correlation_with_constant_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 6.0), (4.0, 5.0, 8.0)],
                               "a double, c double, b double")
    long = {(r["x"], r["y"]): r["r"] for r in G.correlation_matrix(df, ["a", "c", "b"]).collect()}
    assert long[("a", "c")] is None  # constant column: pandas NaN, never an ANSI error
    assert long[("a", "b")] == pytest.approx(float(np.corrcoef([1, 3, 4], [2, 6, 8])[0, 1]))
    assert long[("a", "a")] == 1.0
