"""JSON arrays of any size: one file is read, and written, by many tasks.

A file is cut at every ``}`` by the text reader, which splits it between tasks. Whether a piece starts
inside a string, and at what depth, follows from running sums: over the pieces of a split in a window, over the
splits in a table with one row per split. As a split doesn't know whether it starts inside a string, depths
are summed for both cases and the right one is chosen afterwards. Pieces up to a ``}`` that returns to depth 1 are
one element; they are put together by the element's number and written as JSON lines in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"), "value")


def first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file that is no white space ("" for none)."""
    head = _pieces(spark, path).filter("split = 0").select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)).first()
    return head[0] if head else ""


def _occurrences(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _levels(outside: Column, ends_outside: Column) -> Column:
    """By how many levels a piece and its closing brace change the depth."""
    return _occurrences(outside, "{[") - _occurrences(outside, "]") - F.when(ends_outside, 1).otherwise(0)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with ``ends`` (quotes of the split up to the piece's end, odd or even) and the depth there relative to
    the split's start: ``depth_0`` where the split starts outside a string, ``depth_1`` inside."""
    string = r'"[^"]*("|\z)'
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # escapes stand in strings only
    from_outside = F.regexp_replace(plain, string, "")
    from_inside = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*("|\z)', ""), string, "")
    own = Window.partitionBy("file", "split").orderBy("id")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = _pieces(spark, path).withColumn("quotes", _occurrences(plain, '"'))
    even = F.col("quotes") % 2 == 0
    p = p.select("*", _levels(from_outside, even).alias("d_out"), _levels(from_inside, ~even).alias("d_in"),
                 F.sum("quotes").over(so_far).alias("seen"))
    inside = (F.col("seen") - F.col("quotes")) % 2 == 1
    return p.select("file", "split", "id", "value", "quotes", (F.col("seen") % 2).alias("ends"),
                    F.sum(F.when(inside, F.col("d_in")).otherwise(F.col("d_out"))).over(so_far).alias("depth_0"),
                    F.sum(F.when(inside, F.col("d_out")).otherwise(F.col("d_in"))).over(so_far).alias("depth_1"))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(value): the objects of the top-level arrays in ``path``, a text without line breaks each. What is no
    object (a number, an array, a cut-off file) comes as a text that doesn't begin with a brace."""
    pieces = materialize(_placed(spark, path), "json-pieces")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = {name: F.coalesce(F.sum(name).over(earlier), F.lit(0)) for name in ("quotes", "depth", "ended")}
    # tables with one row per split
    splits = pieces.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), F.max_by("depth_0", "id").alias("depth_0"),
                                                 F.max_by("depth_1", "id").alias("depth_1"))
    splits = splits.withColumn("starts", before["quotes"] % 2)
    splits = splits.withColumn("depth", F.when(F.col("starts") == 1, F.col("depth_1")).otherwise(F.col("depth_0")))
    splits = splits.select("file", "split", "starts", before["depth"].alias("start_depth"))
    depth = F.col("start_depth") + F.when(F.col("starts") == 1, F.col("depth_1")).otherwise(F.col("depth_0"))
    ended = (F.col("starts") == F.col("ends")) & (depth == 1)
    known = pieces.join(F.broadcast(splits), ["file", "split"]).withColumn("ended", F.when(ended, 1).otherwise(0))
    numbers = known.groupBy("file", "split").agg(F.sum("ended").alias("ended"), F.max_by("ended", "id").alias("last"))
    # A file that is whole has its closing bracket after the last object.
    cut_off = numbers.groupBy("file").agg(F.max_by("last", "split").alias("last")).filter("last = 1").select(F.lit("?").alias("value"))
    numbers = numbers.select("file", "split", before["ended"].alias("first"))
    own = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = known.join(F.broadcast(numbers), ["file", "split"]).withColumn(
        "element", F.col("first") + F.sum("ended").over(own) - F.col("ended"))
    parts = F.array_sort(F.collect_list(F.struct("split", "id", "value")))  # of one element
    text = F.array_join(F.transform(parts, lambda x: x["value"]), "}")
    whole = numbered.groupBy("file", "element").agg(text.alias("text"), F.max("ended").alias("closed"))
    first = F.col("element") == 0
    led = F.when(first, F.col("text").rlike(r"^\s*\[")).otherwise(F.col("text").rlike(r"^\s*,"))
    bare = F.concat(F.regexp_replace("text", r"^\s*[,\[]\s*", ""), F.lit("}"))
    end = F.when(first, r"^\s*\[\s*\]\s*$").otherwise(r"^\s*\]\s*$")  # what is left after the last object
    trimmed = F.when(F.col("closed") == 1, F.when(led, bare).otherwise(F.concat(F.lit("?"), "text"))).otherwise(
        F.when(F.col("text").rlike(r"\S") & ~F.regexp_like("text", end), F.concat(F.lit("?"), "text")).otherwise(""))
    lines = whole.select(F.regexp_replace(trimmed, r"[\r\n]+", " ").alias("value")).filter("value <> ''")
    return lines.unionByName(cut_off)


def array_lines(spark: SparkSession, path: str) -> str | None:
    """The path of JSON lines with the arrays' objects, or None if there is anything else in them."""
    out = scratch_path(spark, "json-lines")
    array_elements(spark, path).write.text(out)
    lines = spark.read.text(out)
    return out if lines.filter(~F.col("value").startswith("{")).isEmpty() else None


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON array per part file, written in parallel; null fields are left out, a part without rows is ``[]``."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            if b.num_rows:
                rows = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([(lead if i == 0 else ",") + r for i, r in enumerate(rows)])], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])

    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")) \
        .mapInArrow(lines, "value string").write.mode(mode).text(path)
    return path
