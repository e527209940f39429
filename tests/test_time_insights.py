"""Time intelligence gates and gaps, root cause chain and fact consistency."""
from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators import insights as I
from ledgerlens.operators import rank as Rk
from ledgerlens.operators import rootcause as RC
from ledgerlens.operators import timeseries as H
from ledgerlens.plans.sales_view import sales


def _series(spark, months):
    rows = [(dt.datetime(2023, 1, 1) + dt.timedelta(days=31 * i), float(100 + 10 * i)) for i in months]
    return spark.createDataFrame(rows, "d timestamp, revenue double")


def test_mom_uses_present_rows_and_gates(spark):
    s = _series(spark, [0, 1, 2, 5])  # a gap of two months before the last one
    m = H.monthly_table(s, "d", {"revenue": "sum"})
    mom = H.mom_growth(m, "revenue").first()
    assert mom["previous_period"] == "2023-03" and mom["current_period"] == "2023-06"
    assert mom["growth_pct"] == pytest.approx((150 - 120) / 120 * 100)
    assert H.yoy_growth(m, "revenue").count() == 0  # fewer than 13 months
    assert H.seasonality(m, "revenue").count() == 0  # fewer than 24 months
    assert H.forecast_monthly(m, "revenue").count() == 0  # fewer than 6 months


def test_forecast_and_yoy(spark):
    s = _series(spark, list(range(14)))
    m = H.monthly_table(s, "d", {"revenue": "sum"})
    f = H.forecast_monthly(m, "revenue", 3).filter(F.col("kind") == "forecast").orderBy("year_month").collect()
    assert [r["value"] for r in f] == pytest.approx([240.0, 250.0, 260.0])
    assert f[0]["r2"] == pytest.approx(1.0)
    y = H.yoy_growth(m, "revenue").first()
    assert y["previous_period"] == "2023-02" and y["growth_pct"] == pytest.approx((230 - 110) / 110 * 100)


def test_split_periods_fallback(spark):
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)] * 5, "d timestamp, v double")
    assert {r[0] for r in H.split_periods(one, "d").select("period_half").distinct().collect()} == {"current"}


def test_drill_down_chain_consistent(spark):
    s = sales(spark, SF_SMALL)
    chain = RC.drill_down(s, ["product", "city", "region", "category"], "revenue").collect()
    assert [r["dimension"] for r in chain][:2] == ["region", "city"]
    first = RC.weakest_segment(s, "region", "revenue").first()
    assert chain[0]["value"] == first["value"] and chain[0]["metric_value"] == pytest.approx(first["metric_value"])
    assert all(0 <= r["share_of_total"] <= 100 for r in chain)


def test_contributors_sum_to_100_when_uncut(spark):
    s = sales(spark, SF_SMALL)
    c = RC.contributors_by_half(s, "order_date", "region", "revenue", n=100).collect()
    assert sum(r["contribution_pct"] for r in c) == pytest.approx(100.0)


def test_pareto_monotone_and_shares(spark):
    s = sales(spark, SF_SMALL)
    p = Rk.pareto(s, "product").orderBy("position").collect()
    cums = [r["cum_pct"] for r in p]
    assert cums == sorted(cums) and cums[-1] == pytest.approx(100.0)
    shares = Rk.rank_with_share(s, "category").collect()
    assert sum(r["share_pct"] for r in shares) == pytest.approx(100.0)


def test_facts_equal_components(spark):
    s = sales(spark, SF_SMALL)
    facts = {r["fact"]: r for r in I.executive_summary(s).collect()}
    gap = Rk.leader_gap(s, "city").first()
    assert facts["best_city"]["subject"] == gap["best"]
    assert facts["weakest_city_gap"]["value"] == pytest.approx(gap["gap_pct"])
    ins = {r["fact"]: r for r in I.insights(s).collect()}
    assert 0 <= ins["promo_p_value"]["value"] <= 1


def test_report_kpis_split_rules(spark):
    rows = [(dt.datetime(2024, 1, d), 10.0 * d, 1.0, 1) for d in (1, 2, 3, 10, 11, 12)] + [(None, 100.0, 5.0, 1)]
    df = spark.createDataFrame(rows, "d timestamp, rev double, pro double, n int")
    k = {r["metric"]: r for r in I.report_kpis(df, "rev", "pro", "n", "d").collect()}
    # midpoint 6.5 Jan: current = 10, 11, 12 (undated row excluded), previous = 1, 2, 3
    assert k["revenue"]["current"] == 330.0 and k["revenue"]["previous"] == 60.0
    one_day = spark.createDataFrame([(dt.datetime(2024, 1, 1), 5.0, 1.0, 1)] * 5, "d timestamp, rev double, pro double, n int")
    k1 = {r["metric"]: r for r in I.report_kpis(one_day, "rev", "pro", "n", "d").collect()}
    assert k1["revenue"]["current"] == 25.0 and k1["revenue"]["previous"] is None and k1["growth"]["current"] is None
