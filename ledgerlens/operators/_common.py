"""Small shared building blocks for the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from ..functions.expr import c


def dsum(x) -> Column:
    """Sum that is exact for decimals and returned as double (T3); 0 for no rows."""
    return F.coalesce(F.sum(c(x)), F.lit(0)).cast("double")


def dmean(x) -> Column:
    """Mean as exact-sum / count in double arithmetic: bit-identical across engines for
    decimal and integer inputs."""
    return F.try_divide(F.sum(c(x)).cast("double"), F.count(c(x)).cast("double"))


def nonnull(df: DataFrame, *cols: str) -> DataFrame:
    """T5: pandas group-bys drop null keys."""
    cond = None
    for k in cols:
        e = F.col(k).isNotNull()
        cond = e if cond is None else cond & e
    return df if cond is None else df.filter(cond)


def ranked_desc(value: str, key: str) -> list[Column]:
    """Deterministic descending order: value desc, then key asc."""
    return [F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last()]


def whole(df_window_order: list[Column] | None = None):
    """A window over the whole (already aggregated, metadata-sized) result."""
    w = Window.partitionBy(F.lit(1))
    return w.orderBy(*df_window_order) if df_window_order else w


def one_row(df: DataFrame) -> DataFrame:
    """Mark a 1-row aggregate for broadcast: its size is bounded by construction."""
    return F.broadcast(df)


@dataclass(frozen=True)
class SalesCols:
    """Column names of the sales vocabulary; override to run on any schema."""
    revenue: str = "revenue"
    orders: str = "orders"
    profit: str = "profit"
    margin: str = "margin_pct"
    price: str = "current_price"
    original: str = "original_price"
    discount: str = "discount"
    promo: str = "promo"
    category: str = "category"
    city: str = "city"
    product: str = "product"
    date: str = "order_date"
    customer: str = "customer_id"
    order_id: str = "order_id"


SALES = SalesCols()


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def positions(df: DataFrame, order: list[Column], running: tuple[str, ...] = (),
              name: str = "position") -> DataFrame:
    """Global 1-based position in ``order`` plus running sums ``cum_<col>``.

    The rows are range-sorted into the shared checkpoint folder, which fixes the partition layout
    for the two uses below. A row's place in its partition comes from
    ``monotonically_increasing_id``; the partitions' offsets come from a table with one row per
    partition. No window ever covers more than one partition's rows or that table.
    """
    sorted_df = checkpointed(df.orderBy(*order))
    ided = (sorted_df.withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()))
    ided = ided.withColumn("_lid", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    part_aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(c(r)).alias(f"_s_{r}") for r in running]
    per_part = ided.groupBy("_pid").agg(*part_aggs)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_s_{r}").over(before), F.lit(0)).alias(f"_o_{r}") for r in running])
    out = ided.join(F.broadcast(offsets), "_pid")  # one row per partition
    cols = [F.col("*"), (F.col("_off") + F.col("_lid") + 1).alias(name)]
    if running:
        local = Window.partitionBy("_pid").orderBy("_lid").rowsBetween(Window.unboundedPreceding, 0)
        cols += [(F.col(f"_o_{r}") + F.sum(c(r)).over(local)).alias(f"cum_{r}") for r in running]
    out = out.select(*cols)
    return out.drop("_pid", "_mid", "_lid", "_off", *[f"_o_{r}" for r in running])
