"""Sources and sinks.

Readers return Spark DataFrames; format sniffing only peeks at the first lines of a file
(bounded), never reads a whole file on the driver. Excel/ODS are recognised but not read (no
distributed codec is available; see README).
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_arrays import array_lines, first_character

# File-extension categories.
STRUCTURED_EXTENSIONS = {"csv", "tsv", "xlsx", "xls", "xlsm", "parquet", "ods"}
SEMI_STRUCTURED_EXTENSIONS = {"json", "jsonl", "xml"}
DOCUMENT_EXTENSIONS = {"pdf", "doc", "docx", "txt", "rtf"}
PRESENTATION_EXTENSIONS = {"ppt", "pptx"}
IMAGE_EXTENSIONS = {"png", "jpg", "jpeg", "webp"}
READABLE_NOW = {"csv", "tsv", "json", "jsonl", "xml", "parquet"}
SNIFF_BYTES = 4096


class UnsupportedFormatError(ValueError):
    """A recognised but unreadable (or unknown) format, with the reason."""


class EmptyDatasetError(ValueError):
    """The file was read but holds no data rows."""


def extension(path: str) -> str:
    base = os.path.basename(path.rstrip("/"))
    return base.lower().rsplit(".", 1)[-1] if "." in base else ""


def classify(path: str) -> dict:
    """File category from the extension (structured / semi_structured / document / presentation /
    image / unknown) and whether it can be loaded now."""
    ext = extension(path)
    cat = ("structured" if ext in STRUCTURED_EXTENSIONS else "semi_structured" if ext in SEMI_STRUCTURED_EXTENSIONS
           else "document" if ext in DOCUMENT_EXTENSIONS else "presentation" if ext in PRESENTATION_EXTENSIONS
           else "image" if ext in IMAGE_EXTENSIONS else "unknown")
    return dict(extension=ext, category=cat, supported_now=cat in ("structured", "semi_structured"),
                readable=ext in READABLE_NOW)


def category_expr(ext_col) -> F.Column:
    def isin(s):
        return ext_col.isin(*sorted(s))
    return (F.when(isin(STRUCTURED_EXTENSIONS), "structured").when(isin(SEMI_STRUCTURED_EXTENSIONS), "semi_structured")
            .when(isin(DOCUMENT_EXTENSIONS), "document").when(isin(PRESENTATION_EXTENSIONS), "presentation")
            .when(isin(IMAGE_EXTENSIONS), "image").otherwise("unknown"))


def classify_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """Classify every file of a directory from file metadata only (the ``content`` column of
    the binaryFile source is never selected, so no file body is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1))
    return files.select("path", "length", "modificationTime", ext.alias("extension")) \
        .withColumn("category", category_expr(F.col("extension"))) \
        .withColumn("supported_now", F.col("category").isin("structured", "semi_structured"))


def _head_text(spark: SparkSession, path: str, nbytes: int = SNIFF_BYTES) -> str:
    lines = spark.read.text(path).select(F.substring("value", 1, nbytes)).limit(256).collect()
    out, size = [], 0
    for r in lines:
        line = r[0] or ""
        out.append(line)
        size += len(line) + 1
        if size >= nbytes:
            break
    return "\n".join(out)[:nbytes]


def _require_rows(df: DataFrame, fmt: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyDatasetError(f"{fmt} file was read but contains no data rows.")
    return df


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, infer_schema: bool = True,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """Header row; ``.tsv`` -> tab; otherwise tab when the first 4,096 bytes hold more tabs
    than commas. Pass ``schema`` at scale to skip the inference pass."""
    if sep is None:
        if extension(path) == "tsv":
            sep = "\t"
        else:
            head = _head_text(spark, path)
            sep = "\t" if head.count("\t") > head.count(",") else ","
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer_schema)
    return _require_rows(reader.csv(path), "CSV" if sep == "," else "TSV")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> dotted top-level columns (``json_normalize``); arrays are kept."""
    def walk(dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f.dataType, path + [f.name])
        else:
            yield path
    cols = []
    for f in df.schema.fields:
        for p in walk(f.dataType, [f.name]):
            ref = F.col(".".join(f"`{x}`" for x in p))
            cols.append(ref.alias(sep.join(p)))
    return df.select(*cols)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A top-level array -> one row per element; an object -> the rows of its first field
    that is a non-empty list of objects, else the object as one row; nested objects flattened to
    ``a.b``, arrays kept. An array of objects is split between tasks however large one file is
    (``json_arrays``); an object is read by one task."""
    kind = first_character(spark, path)
    lines = array_lines(spark, path) if kind == "[" else None
    raw = spark.read.json(lines) if lines else spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in raw.columns and (lines or len(raw.columns) == 1):
        raise UnsupportedFormatError("JSON top level is not an object or array that can be flattened into a table.")
    if kind == "{":
        for f in raw.schema.fields:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                rows = raw.select(F.explode(F.col(f"`{f.name}`")).alias("_r")).select("_r.*")
                if not rows.isEmpty():
                    return flatten(rows)
    return _require_rows(flatten(raw), "JSON")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per non-blank line, flattened."""
    return _require_rows(flatten(spark.read.json(path)), "JSONL")


def sniff_row_tag(spark: SparkSession, path: str) -> str:
    head = _head_text(spark, path)
    tags = [t for t in re.findall(r"<\s*([A-Za-z_][\w.\-]*)[^>]*?>", head)]
    if len(tags) < 2:
        raise UnsupportedFormatError("Couldn't find a repeating record structure in this XML file.")
    return tags[1]


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Repeated children of the root element become rows (``rowTag`` sniffed from the first
    child tag when not given)."""
    tag = row_tag or sniff_row_tag(spark, path)
    return _require_rows(flatten(spark.read.format("xml").option("rowTag", tag).load(path)), "XML")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; an empty table is an error."""
    return _require_rows(spark.read.parquet(path), "Parquet")


@dataclass
class Loaded:
    df: DataFrame
    format: str
    category: str


def load(spark: SparkSession, path: str) -> Loaded:
    """Dispatch on the extension; recognised-but-unreadable formats raise
    ``UnsupportedFormatError`` with the reason."""
    info = classify(path)
    ext = info["extension"]
    readers = {"csv": lambda: read_delimited(spark, path), "tsv": lambda: read_delimited(spark, path, "\t"),
               "json": lambda: read_json(spark, path), "jsonl": lambda: read_jsonl(spark, path),
               "xml": lambda: read_xml(spark, path), "parquet": lambda: read_parquet(spark, path)}
    if ext in readers:
        return Loaded(readers[ext](), ext.upper(), info["category"])
    if ext in {"xlsx", "xls", "xlsm", "ods"}:
        raise UnsupportedFormatError(f"'.{ext}' spreadsheets are recognised but not readable here: no distributed "
                                     "reader for that codec is installed; export the sheet to CSV or Parquet.")
    raise UnsupportedFormatError(f"'.{ext}' isn't a structured/semi-structured format that can be turned into a "
                                 f"dataset (category: {info['category']}).")


# The reference sales column names -> this library's sales vocabulary.
SALES_RENAMES = {"Product Name": "product", "Category": "category", "City": "city", "Original Price": "original_price",
                 "Current Price": "current_price", "Discount": "discount", "Orders": "orders",
                 "Total Revenue": "revenue", "Influencer Active": "promo"}


def load_sales(spark: SparkSession, path: str, alias_map: dict[str, str] | None = None) -> DataFrame:
    """Load, trim names, check the 8 required columns (K06), rename to the sales vocabulary
    and run the sales cleaning chain (C10)."""
    from ..operators.clean import clean_sales, validate_columns
    from ..operators.quality import REQUIRED_COLUMNS
    df = validate_columns(load(spark, path).df, REQUIRED_COLUMNS)
    df = df.select(*[F.col(f"`{c}`").alias(SALES_RENAMES.get(c, c)) for c in df.columns])
    return clean_sales(df, alias_map=alias_map)


def append_dataset(base: DataFrame, new: DataFrame) -> DataFrame:
    """A10: concatenate by column name, columns missing on either side become null."""
    return base.unionByName(new, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    """CSV with a header row (one part file per partition, written in parallel), its files compressed if asked for."""
    df.write.mode(mode).option("header", True).option("compression", compression).csv(path)
    return path


def export_report_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """One directory per report table (KPI Summary, Regional, Top Products, Categories, Data
    Quality, Raw Data, ...); the raw data is exported whole (no row cap)."""
    out = {}
    for name, df in tables.items():
        safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", name).strip("_").lower()
        target = os.path.join(path, safe)
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(target) if fmt == "csv" else w.format(fmt).save(target))
        out[name] = target
    return out
