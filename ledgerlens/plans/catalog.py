"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Each entry is ``name -> (builder(spark, sf_dir) -> DataFrame, oracle SQL or None)``. Builders
run the library operator over the whole tables of a scale-factor directory. Oracle SQL is plain
ANSI SQL over the pre-registered base tables; ``sales_cte`` prepends the shared view text.
Values that are not exact in floating point (means/std of doubles) are rounded to 6 dp in both
engines so the comparison does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sales_view import read_table, sales, sales_cte

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None, with_sales: bool = True):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, (sales_cte(sql) if with_sales else sql) if sql else None)
        return fn
    return deco


def rnd(df: DataFrame, *cols: str, dp: int = 6) -> DataFrame:
    """Round the named (or, with none named, all double) columns."""
    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.select(*[F.round(F.col(f"`{c}`"), dp).alias(c) if c in names else F.col(f"`{c}`")
                       for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# Importing the modules below fills REGISTRY.
from . import q_aggregate  # noqa: E402,F401
from . import q_rank  # noqa: E402,F401
from . import q_stats  # noqa: E402,F401
from . import q_time  # noqa: E402,F401
from . import q_clean  # noqa: E402,F401
from . import q_profile  # noqa: E402,F401
from . import q_insights  # noqa: E402,F401
from . import q_sources  # noqa: E402,F401
from . import q_plans  # noqa: E402,F401
