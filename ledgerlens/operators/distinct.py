"""Distinct counts of many columns at once.

Decisions about columns (nearly unique? few values? constant?) compare a distinct count with a threshold. A
mergeable sketch per column, filled in the pass that makes the other statistics, settles nearly all of them; only
columns whose sketch lies too close to a threshold are counted exactly (``settled``), each by a pruned scan of its
own (``exact_counts``). Cells of several tables meet by value under typed carriers (``tagged_values``).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import is_float, nan_to_null, qcol

LG_K = 14
#: Five times the sketch's relative standard error (0.8 % for 2**14 buckets), and two for rounding.
MARGIN, ROUNDING = 5 * 0.0081, 2
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_of(df: DataFrame, column: str) -> Column:
    """The column without NaN."""
    c = qcol(column)
    return nan_to_null(c) if is_float(df.schema[column].dataType) else c


def sketched(df: DataFrame, column: str) -> Column:
    """Estimated number of distinct non-null, non-NaN values, as an aggregate."""
    value, kind = value_of(df, column), df.schema[column].dataType
    if not isinstance(kind, (T.IntegerType, T.LongType, T.StringType)):  # types that a sketch takes as they are
        value = F.when(value.isNotNull(), F.xxhash64(value))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(LG_K))), F.lit(0)).cast("long")


def undecided(estimate: int, thresholds: Iterable[float]) -> bool:
    """Whether the true count and its estimate can lie on different sides of a threshold."""
    return any(abs(estimate - t) <= MARGIN * estimate + ROUNDING for t in thresholds)


#: Columns that carry a value, each with its type.
CARRIERS = {"whole": "long", "real": "double", "text": "string"}


def carrier(df: DataFrame, column: str) -> str:
    """The carrier that the column's type fits."""
    kind = df.schema[column].dataType
    return "whole" if isinstance(kind, _WHOLE) else "real" if is_float(kind) else "text"


def carried(df: DataFrame, column: str, name: str) -> list[Column]:
    """The value as one of the carriers, the others null; equal values have equal carriers."""
    value = value_of(df, column).cast(CARRIERS[name])
    if name == "real":
        value = value + F.lit(0.0)  # -0.0 and 0.0 are one value
    return [(value if n == name else F.lit(None).cast(t)).alias(n) for n, t in CARRIERS.items()]


def tagged_values(df: DataFrame, tags: dict[str, list[Column]], names: dict[str, str] | None = None) -> DataFrame:
    """One row per cell of the columns in ``tags`` that is not null: the column's tags and its carriers (``names``: other
    carriers than those of the types); one scan."""
    names = {c: carrier(df, c) for c in tags} | (names or {})
    rows = df.select(F.inline(F.array(*[F.struct(*own, *carried(df, c, names[c])) for c, own in tags.items()])))
    return rows.filter(reduce(or_, [F.col(n).isNotNull() for n in CARRIERS]))


def exact_counts(tables: dict[str, DataFrame], columns: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(table, position, unique): exact distinct counts of the non-null, non-NaN values of the given (table, column)
    pairs, by default of all columns.

    Each column is a pruned scan and an aggregation of its own in one job: tables of files read every column once in
    all, and no row is expanded to a copy per column. Persist inputs that are costly to compute."""
    asked = None if columns is None else set(columns)
    parts = [df.select(value_of(df, c).alias("v")).filter(F.col("v").isNotNull()).distinct().agg(
                 F.count(F.lit(1)).alias("unique")).select(F.lit(name).alias("table"), F.lit(i).alias("position"), "unique")
             for name, df in tables.items() for i, c in enumerate(df.columns) if asked is None or (name, c) in asked]
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, position int, unique long")
    return reduce(lambda a, b: a.unionByName(b), parts)


def settled(df: DataFrame, estimates: dict[str, int], thresholds: Iterable[float]) -> dict[str, int]:
    """The estimates, those of undecided columns replaced by exact counts (one scan for all of them, none if there
    are none)."""
    thresholds = list(thresholds)
    open_columns = [c for c, e in estimates.items() if undecided(e, thresholds)]
    if not open_columns:
        return dict(estimates)
    place = {i: c for i, c in enumerate(df.columns)}
    exact = {place[r.position]: r.unique for r in exact_counts({"t": df}, [("t", c) for c in open_columns]).collect()}
    return estimates | {c: exact.get(c, 0) for c in open_columns}
