"""Projection, filter and paging operators.

Equality filters are plain predicates, so Catalyst pushes them into the Parquet scan
(``PushedFilters``). Paging uses the distributed ``positions`` numbering instead of a large
``OFFSET`` that would make every task keep ``offset + size`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import all_of, any_of, contains_ci, qcol
from ._common import SALES, SalesCols, positions

NO_FILTER = (None, "", "All")


def filter_sales(df: DataFrame, city: str | None = None, category: str | None = None,
                 promo: str | None = None, product: str | None = None,
                 cols: SalesCols = SALES) -> DataFrame:
    """AND of equality filters; ``None``, ``""`` and ``"All"`` mean no filter."""
    conds = [F.col(c) == F.lit(v) for c, v in
             ((cols.city, city), (cols.category, category), (cols.promo, promo), (cols.product, product))
             if v not in NO_FILTER]
    return df.filter(all_of(conds)) if conds else df


def search_product(df: DataFrame, pattern: str, col: str = "product") -> DataFrame:
    """Case-insensitive regex containment (pandas ``str.contains`` default); null -> no match."""
    if not pattern:
        return df
    return df.filter(contains_ci(qcol(col), pattern))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def search_any_text(df: DataFrame, pattern: str) -> DataFrame:
    """Rows where any text column matches the pattern (case-insensitive regex)."""
    if not pattern:
        return df
    return df.filter(any_of([contains_ci(qcol(c), pattern) for c in text_columns(df)]))


def scatter_points(df: DataFrame, cols: SalesCols = SALES) -> DataFrame:
    """(name, orders, revenue, category) projection for scatter plots."""
    return df.select(F.col(cols.product).alias("name"), F.col(cols.orders).alias("orders"),
                     F.col(cols.revenue).cast("double").alias("revenue"),
                     F.col(cols.category).alias("category"))


def filter_options(df: DataFrame, dims: dict[str, str] | None = None) -> DataFrame:
    """Sorted distinct values of each filter dimension, long form (kind, value) from one
    aggregation (``GROUPING SETS`` over the dimensions)."""
    dims = dims or {"cities": "city", "categories": "category", "products": "product"}
    names = list(dims)
    base = df.select(*[F.col(c).cast("string").alias(f"_{k}") for k, c in dims.items()])
    g = base.groupingSets([[f"_{k}"] for k in names], *[f"_{k}" for k in names]).agg(
        F.grouping_id().alias("_gid"))
    n = len(names)
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, k in enumerate(names):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        kind = F.when(F.col("_gid") == gid, F.lit(k)).otherwise(kind)
        value = F.when(F.col("_gid") == gid, F.col(f"_{k}")).otherwise(value)
    return g.select(kind.alias("kind"), value.alias("value")).filter(F.col("value").isNotNull()) \
        .orderBy("kind", "value")


def page(df: DataFrame, page_no: int = 1, page_size: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """Rows of one 1-based page in a stated order, with ``total`` rows and ``pages`` =
    ceil(total / size) on each row. An order key is required (Spark rows have no index, T9)."""
    if not order_by:
        raise ValueError("page() needs an explicit order: Spark tables have no row index")
    numbered = positions(df, [qcol(c).asc_nulls_first() for c in order_by], name="_row")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    lo = (page_no - 1) * page_size
    rows = numbered.filter((F.col("_row") > lo) & (F.col("_row") <= lo + page_size))
    return (rows.crossJoin(F.broadcast(total))
            .withColumn("pages", F.ceil(F.col("total") / F.lit(page_size)).cast("long"))
            .withColumnRenamed("_row", "row_number"))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose every column is missing (NaN counts as missing, T2)."""
    miss = [qcol(f.name).isNull() | (F.isnan(qcol(f.name)) if isinstance(f.dataType, (T.FloatType, T.DoubleType))
                                     else F.lit(False)) for f in df.schema.fields]
    return df.filter(~all_of(miss))


def complete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Keep rows without any missing value (NaN counts as missing)."""
    fields = [f for f in df.schema.fields if subset is None or f.name in subset]
    ok = [qcol(f.name).isNotNull() & (~F.isnan(qcol(f.name)) if isinstance(f.dataType, (T.FloatType, T.DoubleType))
                                      else F.lit(True)) for f in fields]
    return df.filter(all_of(ok))
