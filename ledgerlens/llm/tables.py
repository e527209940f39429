"""Reading tables, written stages and salted lookups shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: later steps start there,
    also after an executor is lost. ``compression`` is the codec, by default the session's."""
    if compression is None:
        return materialize(df, f"llm-{name}")
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt_count(spark: SparkSession) -> int:
    """Parts into which one hot key is dealt: as many as there are shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt_of(spark: SparkSession, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salt_count(spark))).cast("int")


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` left-joined with ``lookup`` (one row per ``key``) although one key may hold a third
    of the rows.

    The distinct (key, salt) pairs of the rows, at most ``salt_count`` per key, fetch the looked-up
    columns; the rows then join on key and salt, so a hot key is dealt over all tasks. ``spread``
    names the column the salt is taken from. Keys must not be null."""
    spark = rows.sparkSession
    salted = rows.withColumn("_salt", salt_of(spark, spread))
    parts = salted.select(key, "_salt").distinct().join(lookup, key, "left")
    return salted.join(parts, [key, "_salt"], "left").drop("_salt")


def per_text(docs: DataFrame, columns: str, make: Callable[[], Callable[[list], list]],
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``columns``): values computed in tasks from each whole text, ids untouched.

    ``make`` is called once per task and gives the function from a text to a row's values."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([source.schema["id"], *StructType.fromDDL(columns)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            rows = [of(t) for t in b.column(1).to_pylist()]
            values = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow[0].type), *values], schema=arrow)

    return source.mapInArrow(run, schema)
