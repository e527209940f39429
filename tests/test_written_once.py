"""What many sections or queries read is made once, and no larger than needed."""

from __future__ import annotations

from conftest import SF_SMALL
from pyspark.sql import functions as F

from ledgerlens.operators import clean as C
from ledgerlens.plans import report as RP
from ledgerlens.plans import sales_view as V
from ledgerlens.sources import readers as R


def test_the_sections_of_an_eda_report_share_the_rows_without_duplicates(spark, monkeypatch):
    made = []
    dedupe = RP.C.dedupe
    monkeypatch.setattr(RP.C, "dedupe", lambda df: made.append(dedupe(df)) or made[-1])
    raw = spark.range(60).select((F.col("id") % 3).cast("string").alias("kind"), (F.col("id") % 30).alias("size"),
                                 (F.col("id") % 20 / 2).alias("price"))
    out = RP.eda_report(raw.unionByName(raw))
    assert [df.storageLevel.useDisk for df in made] == [True]
    summary = out["cleaning_summary"].first()
    assert (summary.rows_before, summary.rows_after, summary.duplicates) == (120, 60, 60)


def test_the_copy_of_the_sales_view_holds_no_derived_columns(spark):
    sales = V.sales(spark, SF_SMALL)
    assert sales.columns == V.SALES_COLUMNS
    path = list(V._MATERIALIZED.values())[-1]
    assert spark.read.parquet(path).columns == [c for c in V.SALES_COLUMNS if c not in ("profit", "margin_pct")]
    view = V.sales_view(spark, SF_SMALL)
    assert [f.dataType for f in sales.schema] == [f.dataType for f in view.schema]
    assert sales.exceptAll(view).isEmpty() and view.exceptAll(sales).isEmpty()


def test_line_items_meet_the_names_of_nations_after_the_parts(spark):
    plan = V.sales_view(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "n_nationkey" in joins[0] and "p_partkey" in joins[1]


def test_a_compressed_export_is_smaller_and_reads_back_whole(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.lit("KRAKÓW, \"old\" town").alias("city"), (F.col("id") % 7).alias("n"))
    size = {}
    for kind in ("none", "gzip"):
        path = R.write_csv(rows, str(tmp_path / kind), compression=kind)
        back = R.read_delimited(spark, path, schema="id long, city string, n long")
        assert back.exceptAll(rows).isEmpty() and back.count() == 20_000
        size[kind] = sum(f.stat().st_size for f in (tmp_path / kind).glob("part-*"))
    assert size["gzip"] < size["none"] / 3


def test_rows_to_clean_by_role_are_copied_by_column(spark):
    rows = [(f"p{i % 40}", "Paris" if i % 3 else None, i % 5 or None, f"2024-01-{i % 28 + 1:02d}") for i in range(400)]
    raw = spark.createDataFrame(rows, "`a, b` string, `A` string, ` a` int, day string")
    roles = {"A": "Dimension", "a": "Measure", "day": "Date"}
    with_void = raw.withColumn("gap", F.lit(None))
    for df, names in ((raw, ["a, b", "A", "a", "day"]), (with_void, ["a, b", "A", "a", "day"])):
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            out, log = C.clean_by_role(df, roles)
            got = {(r.step, r.column): r["count"] for r in log.collect()}
            assert out.columns == names and out.filter("`a` is null or `A` is null or day is null").isEmpty()
            plan = out._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.caseSensitive")
        distinct = set(rows)
        assert got[("imputed_median", "a")] == sum(r[2] is None for r in distinct)
        assert got[("filled_mode", "A")] == sum(r[1] is None for r in distinct)
        assert ("parquet" in plan) == (df is raw)
