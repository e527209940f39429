"""Exact, distributed quantiles (linear interpolation, pandas/NumPy default; trap T11).

``percentile`` keeps every distinct value of a group in one aggregation buffer, so a global
median of a large table would end in one task. Instead (per column, optionally per group), at
every size alike:

1. one aggregation gives the count n and a Greenwald-Khanna sketch bracket
   ``percentile_approx(v, p -+ 4/accuracy)``; the sketch's rank error is at most n/accuracy, so
   the exact order statistics at ranks floor/ceil((n - 1) p) lie inside the bracket;
2. one pass counts equal values inside the bracket, and all values below it as one row. Counting
   happens before the shuffle, so ties, however many, are one row per task;
3. those counts are range-sorted with a running sum (``positions``); the two neighbours of the
   wanted rank are the values whose running counts enclose it.

If a bracket ever missed (it cannot by the sketch's guarantee) the affected quantiles are
recomputed without a bracket, so the result is always exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, materialize
from ..functions.expr import qcol
from ._common import positions

DEFAULT_ACCURACY = 10000


def _long(df: DataFrame, cols: list[str], by: str | None) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("k"), qcol(c).cast("double").alias("v")) for c in cols]
    keep = [qcol(by).alias("_g")] if by else []
    return (df.select(*keep, F.explode(F.array(*parts)).alias("_s"))
            .select(*(["_g"] if by else []), F.col("_s.k").alias("k"), F.col("_s.v").alias("v"))
            .filter(F.col("v").isNotNull() & ~F.isnan("v")))


def _pick(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Exact order statistics of ``rows`` (keys..., v, c: how often; v null: below the bracket).
    ``targets`` has keys..., lo, hi, frac with 0-based ranks per key group (``keys`` ends with "p");
    returns keys..., value (null if the bracket missed)."""
    order = [F.col(x).asc_nulls_first() for x in keys] + [F.col("v").asc_nulls_first()]
    numbered = positions(rows, order, running=("c",), name="_pos").select(
        *keys, "v", F.col("cum_c").alias("end"), (F.col("cum_c") - F.col("c")).alias("start"))
    first = numbered.groupBy(*keys).agg(F.min("start").alias("first"))
    t = targets.join(first, keys).select(*keys, "frac", (F.col("first") + F.col("lo")).alias("lo"),
                                         (F.col("first") + F.col("hi")).alias("hi"))
    near = numbered.join(t, keys).filter((F.col("end") > F.col("lo")) & (F.col("start") <= F.col("hi")))
    v_lo = F.max(F.when((F.col("start") <= F.col("lo")) & (F.col("end") > F.col("lo")), F.col("v")))
    v_hi = F.max(F.when((F.col("start") <= F.col("hi")) & (F.col("end") > F.col("hi")), F.col("v")))
    both = near.groupBy(*keys, "frac").agg(v_lo.alias("v_lo"), v_hi.alias("v_hi"))
    val = F.when(F.col("frac") == 0, F.col("v_lo")).otherwise(
        F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac"))
    return both.select(*keys, val.alias("value"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: str | None = None,
                    accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Long result ``(column, p, value[, by])`` with the interpolated quantile of each column.

    Nulls and NaN are ignored (pandas ``quantile`` semantics). With ``by``, quantiles are per
    group value.
    """
    long = _long(df, cols, by)
    gkeys = ["k", "_g"] if by else ["k"]
    eps = 4.0 / accuracy
    brackets = [max(0.0, p - eps) for p in probs] + [min(1.0, p + eps) for p in probs]
    stats = long.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("n"),
                                     F.percentile_approx("v", brackets, accuracy).alias("ap"))
    m = len(probs)
    tgt = [F.struct(F.lit(float(p)).alias("p"), F.col("ap")[i].alias("b_lo"), F.col("ap")[m + i].alias("b_hi"))
           for i, p in enumerate(probs)]
    targets = stats.select(*gkeys, "n", F.explode(F.array(*tgt)).alias("t")).select(*gkeys, "n", "t.*")
    h = (F.col("n") - 1) * F.col("p")
    # one row per (column[, group], p), written so that the planner knows its size
    targets = materialize(targets.withColumn("lo", F.floor(h).cast("long")).withColumn("hi", F.ceil(h).cast("long"))
                          .withColumn("frac", h - F.floor(h)), "quantile-targets")
    j = long.join(targets.select(*gkeys, "p", "b_lo", "b_hi"), gkeys).filter(F.col("v") <= F.col("b_hi"))
    inside = F.when(F.col("v") >= F.col("b_lo"), F.col("v")).alias("v")
    counts = j.select(*gkeys, "p", inside).groupBy(*gkeys, "p", "v").agg(F.count(F.lit(1)).alias("c"))
    wanted = targets.select(*gkeys, "p", "lo", "hi", "frac")
    res = checkpointed(_pick(counts, wanted, gkeys + ["p"]))  # one row per (column[, group], p)
    missed = res.filter(F.col("value").isNull())
    if not missed.isEmpty():
        again = wanted.join(missed.select(*gkeys, "p"), gkeys + ["p"], "left_semi")
        rows = long.join(again.select(*gkeys, "p"), gkeys).groupBy(*gkeys, "p", "v").agg(F.count(F.lit(1)).alias("c"))
        res = res.filter(F.col("value").isNotNull()).unionByName(_pick(rows, again, gkeys + ["p"]))
    out = res.select(F.col("k").alias("column"), "p", *(["_g"] if by else []), "value")
    return out.withColumnRenamed("_g", by) if by else out


def quantile_row(df: DataFrame, col: str, probs: list[float], names: list[str]) -> DataFrame:
    """One row with one column per requested quantile of ``col`` (null when no values)."""
    q = exact_quantiles(df, [col], probs)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return q.agg(*aggs)


def median_row(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the exact median of each column, named after the column."""
    q = exact_quantiles(df, cols, [0.5])
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols])
