"""Fill values from two scans, against pandas."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from ledgerlens.operators import clean, fills

SCHEMA = "price double, units int, city string, code string, `a.b` string, _hash0 string"


def _data(n: int = 4000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        rows.append((rng.choice([None, float("nan"), rng.random() * 100, 7.5]), rng.choice([None, 1, 2, 3, 900]),
                     rng.choice([None, "Pune", "Delhi", "Delhi", "Goa"]), None if i % 9 == 0 else f"code-{i}",
                     rng.choice([None, "x", "y"]), None))
    return rows


def _mode(values) -> str | None:
    counts = pd.Series([v for v in values if v is not None], dtype=object).value_counts()
    return min(counts.index[counts == counts.max()]) if len(counts) else None


@pytest.mark.parametrize("listed, tracked", [(100, 10000), (2, 50), (1, 10)])
def test_fill_values_equal_pandas(spark, listed, tracked):
    rows = _data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    text = ["city", "code", "a.b", "_hash0"]
    got = fills.fill_facts(df, ["price", "units"], text, listed=listed, tracked=tracked)
    table = pd.DataFrame(rows, columns=["price", "units", *text])
    assert got.rows == len(rows)
    assert got.missing == {c: int(table[c].isna().sum()) for c in table}
    assert got.medians == pytest.approx({c: table[c].median() for c in ("price", "units")})
    assert got.modes == {c: _mode(table[c]) for c in ("city", "code", "a.b")}  # _hash0 has no value to fill with


def test_no_frequent_value_is_counted_whole(spark):
    """A value that is there twice among thousands of single ones is no item of a small sketch."""
    values = [(f"v{i}",) for i in range(5000)] + [("v77",), (None,)]
    df = spark.createDataFrame(values, "v string")
    assert fills.fill_facts(df, [], ["v"], listed=5, tracked=20).modes == {"v": "v77"}


def test_ties_and_columns_without_gaps(spark):
    df = spark.createDataFrame([("b", "k"), ("a", "k"), ("b", "l"), ("a", "l"), (None, "m")], "t string, full string")
    got = fills.fill_facts(df, [], ["t", "full"])
    assert got.modes == {"t": "a"} and got.missing == {"t": 1, "full": 0}


def test_empty_table_and_empty_column(spark):
    df = spark.createDataFrame([], "x double, t string")
    assert fills.fill_facts(df, ["x"], ["t"]) == fills.Fills(0, {"x": 0, "t": 0})
    assert clean.impute(df, ["x"], ["t"]).collect() == []
    df = spark.createDataFrame([(None, None, 1), (None, None, 2)], "x int, t string, k int")
    out = clean.impute(df, ["x"], ["t"])
    assert dict(out.dtypes) == {"x": "double", "t": "string", "k": "int"}
    assert sorted(out.collect(), key=lambda r: r.k) == [(None, None, 1), (None, None, 2)]


def test_clean_by_role_reads_the_deduplicated_table_only(spark):
    rows = [(" Pune", 3.0, "2024-01-05", None), (" Pune", 3.0, "2024-01-05", None), (None, None, "never", None),
            ("Goa", 5.0, "2024-02-06", None), (" Pune", 9.0, None, None)]
    df = spark.createDataFrame(rows, "` city` string, amount double, day string, nothing string")
    roles = {" city": "Dimension", "amount": "Measure", "day": "Date", "nothing": "Dimension"}
    out, log = clean.clean_by_role(df, roles)
    assert sorted(map(tuple, log.collect())) == sorted([
        ("removed_duplicates", None, 1), ("dropped_empty_column", "nothing", 0), ("imputed_median", "amount", 1),
        ("filled_mode", "city", 1), ("parsed_dates", "day", 1)])
    assert out.columns == ["city", "amount", "day"]
    assert sorted((r.city, r.amount, str(r.day)[:10]) for r in out.collect()) == [
        ("Goa", 5.0, "2024-02-06"), ("Pune", 3.0, "2024-01-05"), ("Pune", 5.0, "None"), ("Pune", 9.0, "None")]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
