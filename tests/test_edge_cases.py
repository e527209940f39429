"""Edge cases: empty input, one group, ties, null keys, thresholds never reached."""
from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from ledgerlens.operators import aggregate as A
from ledgerlens.operators import rank as Rk

SCHEMA = ("product string, category string, city string, revenue decimal(12,2), orders int, profit decimal(24,2), "
          "current_price double, margin_pct double, discount int, promo string, order_date timestamp")


def _rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def _r(p, cat, city, rev, orders=1, promo="Yes", day=1):
    rev = Decimal(str(rev))
    return (p, cat, city, rev, orders, rev - Decimal("1.00") * orders, float(rev) / orders,
            0.0 if rev <= 0 else float(rev - Decimal("1.00") * orders) / float(rev) * 100, 5, promo,
            dt.datetime(2024, 1, day))


def test_empty_input(spark):
    df = _rows(spark, [])
    k = A.kpis(df).first()
    assert k["total_revenue"] == 0.0 and k["record_count"] in (0, None)
    assert k["profit_margin"] == 0.0 and k["top_city"] is None
    assert A.revenue_by(df, "city").count() == 0
    assert Rk.pareto(df, "product").count() == 0


def test_ties_null_keys_and_one_group(spark):
    df = _rows(spark, [_r("a", "X", "P", 10), _r("b", "X", "Q", 10), _r("c", None, None, 5), _r("d", "Y", "P", 1)])
    by = [tuple(r) for r in A.revenue_by(df, "city").collect()]
    assert by == [("P", 11.0), ("Q", 10.0)]  # null city dropped (pandas group-by)
    top = [r["product"] for r in A.top_n(df, "product", "revenue", 2).collect()]
    assert top == ["a", "b"]  # tie broken by key
    gap = Rk.leader_gap(df.filter("city = 'Q'"), "city").first()
    assert gap["groups"] == 1 and gap["gap_pct"] == 0.0
    ins = A.aggregate_insight(A.aggregate(df, A.AggSpec("revenue", "product", top_n=None)), "product").first()
    assert ins["leader"] == "a" and ins["trailing"] == "d"


def test_pareto_threshold_and_movers(spark):
    df = _rows(spark, [_r("a", "X", "P", 50), _r("b", "X", "P", 30), _r("c", "X", "P", 20)])
    p = {r["product"]: r for r in Rk.pareto(df, "product", threshold=80).collect()}
    assert p["a"]["cutoff"] == 2 and p["b"]["in_head"] and not p["c"]["in_head"]
    assert Rk.pareto(df, "product", threshold=101).first()["cutoff"] == 3  # never reached -> last
    mv = A.movers(df, 8).collect()
    assert len([r for r in mv if r["kind"] == "fast"]) == 3 and len([r for r in mv if r["kind"] == "slow"]) == 3


def test_price_tier_edges(spark):
    df = spark.createDataFrame([(0.0,), (60.0,), (60.01,), (180.0,), (180.5,), (-1.0,)], "current_price double")
    tiers = [r["price_tier"] for r in A.add_price_tier(df).collect()]
    assert tiers == [None, "₹20–60", "₹61–100", "₹141–180", "₹181+", None]  # right-closed bins
