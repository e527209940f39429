"""Dates and numbers in texts: only texts of a fitting shape are parsed, with the results of a parse of every text."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import expr as E

DATES = ["2024-01-05", "2024-01-05 10:11:12", "2024-01-05t10:11", "2024-01-05 10:11:12.5", "2024/01/05", "01/05/2024", "25/12/2024",
         "25-12-2024", "05 Jan 2024", "5 Jan 2024", "jan 05 2024", "JAN 05, 2024", "Jan 05,2024", "ſep 2024", "January 2024",
         "2024-01", "2024-1", "+12024-01-05", "-2024-01-05", "12024-01-05", " 2024-01-05 ", "2024-01-05\n", "2024-02-30",
         "٢٠٢٤-01-05", "2024-01-05 24:00:00", "", "x", None]
NUMBERS = ["1", "+1", "-1.5", ".5", "5.", ".", "1e5", "1E-3", "1e", "1d", "1F", "1L", "nan", "-NaN", "inf", "+Infinity", "infinit",
           "0x1p3", "0x1.8P-2d", "0x.8p1", "0x1.", "1_000", "1,000", " 1 ", "\t1\n", " 1", "١1", "--1", "", "INDIA",
           "1e400", "1 2", "-0", None]


@pytest.mark.parametrize("formats", [E.DATE_FORMATS_MONTH_FIRST, E.DATE_FORMATS_DAY_FIRST, ["dd.MM.yyyy", "yyyy-MM-dd"]])
def test_dates_are_those_of_a_parse_of_every_text(spark, formats):
    df = spark.createDataFrame([(x,) for x in DATES], "x string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(f)) for f in formats])
    got = df.select("x", plain.cast("string").alias("plain"), E.parse_dates("x", formats=formats).cast("string").alias("parsed")).collect()
    assert [(r.x, r.parsed) for r in got] == [(r.x, r.plain) for r in got]
    assert sum(r.parsed is not None for r in got) >= 3


def test_numbers_are_those_of_a_cast_of_every_text(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x string")
    assert df.filter(~F.col("x").try_cast("double").eqNullSafe(E.to_number("x"))).collect() == []
    assert df.filter(E.to_number("x").isNotNull()).count() == 20


def test_texts_that_are_no_dates_cost_a_look(spark):
    texts = spark.range(0, 100_000, 1, 2).select(F.concat(F.lit("item no. "), F.col("id")).alias("x"))

    def seconds(parsed):
        start = time.perf_counter()
        assert texts.agg(F.count(parsed)).first()[0] == 0
        return time.perf_counter() - start

    every = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(f)) for f in E.DATE_FORMATS_MONTH_FIRST])
    seconds(E.parse_dates("x"))
    assert seconds(E.parse_dates("x")) < seconds(every) / 3
