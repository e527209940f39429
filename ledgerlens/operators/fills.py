"""Fill values of many columns (exact medians, exact modes, missing counts) from two scans.

1. One plain aggregation, no row expanded: per column how many values are missing, per numeric column the
   bracket of its median (``quantiles``), per text column a frequent-items sketch (``approx_top_k``) over
   64-bit hashes of its values, so that the buffer doesn't grow with the texts.
2. Only for columns with something to fill: values inside a bracket and values whose hash the sketch lists are
   counted. Everything else is one row per task (below a bracket) or leaves the scan.

A sketch of ``tracked`` items misplaces a count by at most 3.5 / tracked of the rows, so a value that is more
frequent than twice that is listed. Is the best exact count above that, and above the last listed estimate
where the list is full, then no unlisted value reaches it, and the mode is exact. Only columns
without such a value (none is frequent) are counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import is_float, nan_to_null, qcol
from ..session import materialize
from .quantiles import DEFAULT_ACCURACY, _pick, median_row

LISTED = 100
TRACKED = 10000


@dataclass
class Fills:
    """Driver-side facts, one value per column: ``missing`` and ``extra`` counts, ``rows``, and the fill
    values of the columns that have something to fill."""
    rows: int
    missing: dict[str, int]
    extra: dict[str, int] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    return nan_to_null(qcol(name)) if is_float(df.schema[name].dataType) else qcol(name)


def whole_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column (ties -> smallest): (k, mode).

    Counts per (column, value), then ``min_by`` over (-count, value) per column; no task holds
    a whole column's value map."""
    parts = [F.struct(F.lit(c).alias("k"), qcol(c).cast("string").alias("v")) for c in cols]
    long = df.select(F.explode(F.array(*parts)).alias("s")).select("s.k", "s.v").filter(F.col("v").isNotNull())
    cnt = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    return cnt.groupBy("k").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))


def fill_facts(df: DataFrame, numeric: list[str], text: list[str], count: list[str] | None = None,
               extra: dict[str, Column] | None = None, listed: int = LISTED, tracked: int = TRACKED) -> Fills:
    """Missing counts of ``count`` (default: the columns to fill), counts of rows that meet the conditions
    ``extra``, and the exact median or mode of each column of ``numeric`` and ``text`` that has both missing
    and other values. ``df`` is scanned twice at most, columns without a frequent value excepted."""
    count = list(dict.fromkeys([*numeric, *text, *(count or [])]))
    extra = extra or {}
    eps = 4.0 / DEFAULT_ACCURACY
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(count)]
    aggs += [F.count(F.when(cond, 1)).alias(f"x{i}") for i, cond in enumerate(extra.values())]
    aggs += [F.percentile_approx(present(df, c).cast("double"), [0.5 - eps, 0.5 + eps], DEFAULT_ACCURACY).alias(f"b{i}")
             for i, c in enumerate(numeric)]
    aggs += [F.call_function("approx_top_k", F.when(qcol(c).isNotNull(), F.xxhash64(qcol(c))), F.lit(listed), F.lit(tracked))
             .alias(f"t{i}") for i, c in enumerate(text)]
    row = df.agg(*aggs).first()
    known = {c: row[f"n{i}"] for i, c in enumerate(count)}
    out = Fills(row["rows"], {c: row["rows"] - n for c, n in known.items()},
                {name: row[f"x{i}"] for i, name in enumerate(extra)})
    gaps = {c for c in (*numeric, *text) if out.missing[c] and known[c]}
    number = {c: row[f"b{i}"] for i, c in enumerate(numeric) if c in gaps}
    items = {c: row[f"t{i}"] for i, c in enumerate(text) if c in gaps}
    if gaps:
        _second_scan(df, out, known, number, items, listed, tracked)
    return out


def _second_scan(df: DataFrame, out: Fills, known: dict, number: dict, items: dict, listed: int, tracked: int) -> None:
    no_text = F.lit(None).cast("string")
    parts = []
    for c, (low, high) in number.items():
        v = present(df, c).cast("double")
        inside = F.when(v >= low, v).alias("v")
        parts.append(F.when(v <= high, F.struct(F.lit(c).alias("k"), inside, no_text.alias("s"))))
    for c, found in items.items():
        hashes = [x["item"] for x in found if x["item"] is not None]
        if hashes:
            no_number = F.lit(None).cast("double").alias("v")
            parts.append(F.when(qcol(c).isNotNull() & F.xxhash64(qcol(c)).isin(hashes),
                                F.struct(F.lit(c).alias("k"), no_number, qcol(c).cast("string").alias("s"))))
    counts = None
    if parts:
        # Filtered as rows: a function over an array is not compiled.
        hits = df.select(F.explode(F.array(*parts)).alias("h")).filter("h is not null").select("h.*")
        counts = materialize(hits.groupBy("k", "v", "s").agg(F.count(F.lit(1)).alias("c")), "fill-counts")
    if number:
        ranks = [(c, 0.5, floor((known[c] - 1) / 2), ceil((known[c] - 1) / 2), (known[c] - 1) / 2 % 1.0) for c in number]
        targets = df.sparkSession.createDataFrame(ranks, "k string, p double, lo long, hi long, frac double")
        rows = counts.filter(F.col("k").isin(list(number))).select("k", F.lit(0.5).alias("p"), "v", "c")
        out.medians = {r["k"]: r["value"] for r in _pick(rows, targets, ["k", "p"]).collect() if r["value"] is not None}
        missed = [c for c in number if c not in out.medians]  # a bracket that doesn't hold its ranks
        if missed:
            out.medians |= median_row(df, missed).first().asDict()
    best = {}
    if counts is not None and items:
        order = F.struct(-F.col("c"), F.col("s"))
        best = {r["k"]: r for r in counts.filter(F.col("s").isNotNull()).groupBy("k").agg(
            F.min_by("s", order).alias("mode"), F.max("c").alias("c")).collect()}
    unsure = []
    for c, found in items.items():
        bound = 2 * 3.5 / tracked * out.rows  # missing values are items of the sketch, too
        if len(found) == listed:
            bound = max(bound, min(x["count"] for x in found))
        if c in best and best[c]["c"] > bound:
            out.modes[c] = best[c]["mode"]
        else:
            unsure.append(c)
    if unsure:
        out.modes |= {r["k"]: r["mode"] for r in whole_modes(df, unsure).collect()}
