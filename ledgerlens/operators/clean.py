"""Cleaning and feature-engineering operators (C02-C17) and the column helpers K06-K08.

Column statistics needed for imputation (medians, modes, null counts) are computed in one
distributed job for all columns and joined back as a broadcast one-row table; no per-column
loop of actions, no value map of a whole column in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import is_float, is_numeric, is_temporal, nan_to_null, parse_dates, qcol
from ..session import written
from ._common import SALES, SalesCols, one_row
from .aggregate import add_price_tier
from .fills import Fills, fill_facts, present


# ---------------------------------------------------------------- K06 - K08

def trim_column_names(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace from every column name."""
    return df.select(*[qcol(c).alias(c.strip()) for c in df.columns])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Apply a {old: new} column mapping (unknown names ignored)."""
    return df.select(*[qcol(c).alias(mapping.get(c, c)) for c in df.columns])


class MissingColumnsError(ValueError):
    pass


def validate_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Trim names and fail with the list of missing required columns."""
    out = trim_column_names(df)
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise MissingColumnsError("Missing required columns: " + ", ".join(missing))
    if out.isEmpty():
        raise MissingColumnsError("The file has no data rows")
    return out


# ---------------------------------------------------------------- C02 - C04

def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast to double, unparseable -> null (``try_cast``; ANSI mode never raises, T1)."""
    todo = set(cols)
    return df.select(*[(qcol(c).cast("string").try_cast("double") if dict(df.dtypes)[c] == "string"
                        else qcol(c).cast("double")).alias(c) if c in todo else qcol(c) for c in df.columns])


def impute(df: DataFrame, numeric: list[str], text: list[str], trim: bool = True, facts: Fills | None = None) -> DataFrame:
    """C03 and C04 together: missing (null / NaN) values of ``numeric`` become the column's exact interpolated
    median, those of ``text`` its mode (ties -> smallest), then texts are trimmed. All values come from the two
    scans of ``fill_facts`` (or from ``facts``, made before). A column without any value stays empty. An
    integer or decimal column with missing values becomes double, as its median may lie between two values."""
    if not numeric and not text:
        return df
    facts = facts or fill_facts(df, numeric, text)
    out = []
    for f in df.schema.fields:
        v = qcol(f.name)
        if f.name in numeric:
            kind = f.dataType if is_float(f.dataType) or not facts.missing[f.name] else T.DoubleType()
            v = present(df, f.name).cast(kind)
            if f.name in facts.medians:
                v = F.coalesce(v, F.lit(facts.medians[f.name]).cast(kind))
        elif f.name in text:
            if f.name in facts.modes:
                v = F.coalesce(v, F.lit(facts.modes[f.name]))
            v = F.trim(v) if trim else v
        out.append(v.alias(f.name))
    return df.select(*out)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def impute_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``impute`` for numeric columns (all by default)."""
    return impute(df, cols if cols is not None else numeric_columns(df), [])


def impute_mode(df: DataFrame, cols: list[str] | None = None, trim: bool = True) -> DataFrame:
    """``impute`` for text columns (all by default)."""
    return impute(df, [], cols if cols is not None else text_columns(df), trim)


# ---------------------------------------------------------------- C05 - C09

def add_profit(df: DataFrame, current: str = "current_price", original: str = "original_price",
               orders: str = "orders", name: str = "profit") -> DataFrame:
    """profit = (current - original) x orders."""
    return df.withColumn(name, (qcol(current).cast("double") - qcol(original).cast("double"))
                         * qcol(orders).cast("double"))


def add_margin(df: DataFrame, profit: str = "profit", revenue: str = "revenue",
               name: str = "margin_pct") -> DataFrame:
    """Margin % = profit / revenue x 100 when revenue > 0, else 0."""
    r = qcol(revenue).cast("double")
    return df.withColumn(name, F.when(r > 0, qcol(profit).cast("double") / r * 100.0).otherwise(0.0))


# City alias table (lower-case spelling -> canonical name).
CITY_ALIASES = {
    "bengaluru": "Bangalore", "bangalore": "Bangalore", "bombay": "Mumbai", "mumbai": "Mumbai",
    "delhi": "Delhi", "new delhi": "Delhi", "calcutta": "Kolkata", "kolkata": "Kolkata",
    "madras": "Chennai", "chennai": "Chennai", "hyderabad": "Hyderabad", "pune": "Pune",
}


def standardize_aliases(df: DataFrame, col: str = "city", alias_map: dict[str, str] | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """Map trim+lower spellings through the alias table (a literal map: its size is the
    parameter's, not the data's). Returns the new table and the distinct (original -> canonical)
    pairs that actually changed a value."""
    alias_map = alias_map if alias_map is not None else CITY_ALIASES
    if not alias_map:
        empty = df.sparkSession.createDataFrame([], "original string, standardized string")
        return df, empty
    m = F.create_map(*[x for k, v in alias_map.items() for x in (F.lit(k.strip().lower()), F.lit(v))])
    hit = m[F.lower(F.trim(qcol(col)))]
    new = F.coalesce(hit, qcol(col))
    out = df.withColumn(col, new)
    applied = (df.select(qcol(col).alias("original"), hit.alias("standardized"))
               .filter(F.col("standardized").isNotNull() & (F.col("original") != F.col("standardized")))
               .distinct())
    return out, applied


def dedupe(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (nulls compare equal)."""
    return df.dropDuplicates()


# ---------------------------------------------------------------- C10

SALES_NUMERIC = ("original_price", "current_price", "discount", "orders", "revenue")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    from .filters import drop_empty_rows as _d
    return _d(df)


def clean_sales(df: DataFrame, cols: SalesCols = SALES, alias_map: dict[str, str] | None = None,
                price_edges=None, price_labels=None) -> DataFrame:
    """The sales cleaning chain: trim names (K08) -> drop empty rows (B08) -> coerce the
    five numeric columns (C02) -> median fill of every numeric column (C03) -> mode fill + trim
    of every text column (C04) -> city aliases (C08) -> profit (C05) -> margin (C06) -> price tier
    (C07)."""
    k = cols
    out = drop_empty_rows(trim_column_names(df))
    numeric = [c for c in (k.original, k.price, k.discount, k.orders, k.revenue) if c in out.columns]
    out = coerce_numeric(out, numeric)
    out = impute(out, numeric_columns(out), text_columns(out))
    if k.city in out.columns:
        out, _ = standardize_aliases(out, k.city, alias_map)
    out = add_profit(out, k.price, k.original, k.orders, k.profit)
    out = add_margin(out, k.profit, k.revenue, k.margin)
    return add_price_tier(out, k.price, price_edges, price_labels)


# ---------------------------------------------------------------- C11 - C17

def empty_columns(df: DataFrame) -> list[str]:
    """Names of all-missing columns from one aggregation (a 1-row, column-sized result)."""
    aggs = [F.count(nan_to_null(qcol(f.name)) if is_float(f.dataType) else qcol(f.name)).alias(f"_{i}")
            for i, f in enumerate(df.schema.fields)]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns) if row[f"_{i}"] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """C11: drop columns whose every value is missing."""
    empty = empty_columns(df)
    return df.drop(*empty) if empty else df


def standardize_dates(df: DataFrame, cols: list[str], dayfirst: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parse each column with the mixed-format parser; report per column how many non-null
    values became null (one aggregation for all columns)."""
    parsed = {c: parse_dates(qcol(c), df.schema[c].dataType, dayfirst) for c in cols}
    aggs = [F.count(F.when(qcol(c).isNotNull() & parsed[c].isNull(), 1)).alias(c) for c in cols]
    report = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    report = report.selectExpr(f"stack({len(cols)}, {stack}) AS (column, newly_null)")
    out = df.select(*[parsed[c].alias(c) if c in parsed else qcol(c) for c in df.columns])
    return out, report


def clean_by_role(df: DataFrame, roles: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Dedupe -> trim names -> drop empty columns -> median for Measure columns, mode + trim
    for Dimension text columns, date parsing for Date columns. Returns the table and a log
    (step, column, count) as a DataFrame."""
    spark = df.sparkSession
    log: list[tuple[str, str | None, int]] = []
    before = df.count()
    out = trim_column_names(written(dedupe(df)))  # made once, read by the scans below
    roles = {k.strip(): v for k, v in roles.items()}
    types = dict(out.dtypes)
    having = {role: [c for c, r in roles.items() if r == role and c in types] for role in ("Measure", "Dimension", "Date")}
    measures = [c for c in having["Measure"] if is_numeric(out.schema[c].dataType)]
    dims = [c for c in having["Dimension"] if types[c] == "string"]
    dates = [c for c in having["Date"] if not is_temporal(out.schema[c].dataType)] or having["Date"]
    parsed = {c: parse_dates(qcol(c), out.schema[c].dataType) for c in dates}
    facts = fill_facts(out, measures, dims, count=out.columns,
                       extra={c: qcol(c).isNotNull() & p.isNull() for c, p in parsed.items()})
    if before != facts.rows:
        log.append(("removed_duplicates", None, before - facts.rows))
    empty = [c for c in out.columns if facts.missing[c] == facts.rows]
    log += [("dropped_empty_column", c, 0) for c in empty]
    log += [("imputed_median", c, facts.missing[c]) for c in measures if facts.missing[c] and c not in empty]
    log += [("filled_mode", c, facts.missing[c]) for c in dims if facts.missing[c] and c not in empty]
    out = impute(out, measures, dims, True, facts)
    out = out.select(*[parsed[c].alias(c) if c in parsed else qcol(c) for c in out.columns if c not in empty])
    log += [("parsed_dates", c, n) for c, n in facts.extra.items() if n]
    if not log:
        log.append(("no_changes", None, 0))
    return out, spark.createDataFrame(log, "step string, column string, count long")


def merge_similar_values(df: DataFrame, col: str, group: list[str]) -> DataFrame:
    """Replace every member of ``group`` by the member that is most frequent in the data
    (ties -> smallest; first member when none occurs)."""
    counts = df.filter(qcol(col).isin(group)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    win = counts.agg(F.min_by(col, F.struct(-F.col("n"), qcol(col))).alias("_target"))
    j = df.crossJoin(one_row(win))
    target = F.coalesce(F.col("_target"), F.lit(group[0]))
    return j.withColumn(col, F.when(qcol(col).isin(group), target).otherwise(qcol(col))).drop("_target")


def apply_fixes(df: DataFrame, selected: set[str], colmap: dict[str, str] | None = None,
                similar_groups: list[list[str]] | None = None, alias_map: dict[str, str] | None = None,
                category: str = "category", city: str = "city") -> tuple[DataFrame, DataFrame]:
    """Apply only the chosen fixes ('colmap', 'dupes', 'city_std', 'fill_missing',
    'cat_std::<leader>') in the reference's order; returns the table and a log DataFrame."""
    spark = df.sparkSession
    log: list[tuple[str, str]] = []
    out = df
    if "colmap" in selected and colmap:
        out = rename_columns(out, colmap)
        log.append(("colmap", ", ".join(f"{k}→{v}" for k, v in colmap.items())))
    if "dupes" in selected:
        out = dedupe(out)
        log.append(("dupes", "removed duplicate rows"))
    if "city_std" in selected and city in out.columns:
        out, applied = standardize_aliases(out, city, alias_map)
        pairs = [f"{r['original']}→{r['standardized']}" for r in applied.orderBy("original").collect()]
        if pairs:
            log.append(("city_std", ", ".join(pairs)))
    if "fill_missing" in selected:
        out = impute(out, numeric_columns(out), text_columns(out), trim=False)
        log.append(("fill_missing", "median for numeric, most-common for text"))
    for sid in sorted(s for s in selected if s.startswith("cat_std::")):
        leader = sid.split("::", 1)[1]
        grp = next((g for g in (similar_groups or []) if g and g[0] == leader), None)
        if grp and category in out.columns:
            out = merge_similar_values(out, category, grp)
            log.append(("cat_std", f"merged {grp}"))
    return out, spark.createDataFrame(log or [("none", "no fixes selected")], "fix string, detail string")


def cleaning_summary(raw: DataFrame, clean: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """C17: rows / columns before, rows after, duplicate rows of the raw table and missing count
    per raw column (> 0 only) with its type, long form (one row per column). ``distinct``: the raw
    table's distinct rows, where made before."""
    fields = raw.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count(F.when(qcol(f.name).isNull() | (F.isnan(qcol(f.name)) if is_float(f.dataType) else F.lit(False)), 1))
        .alias(f"_m{i}") for i, f in enumerate(fields)]
    one = raw.agg(*aggs)
    distinct_rows = (raw.dropDuplicates() if distinct is None else distinct).agg(F.count(F.lit(1)).alias("_distinct"))
    after = clean.agg(F.count(F.lit(1)).alias("rows_after"))
    structs = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.col(f"_m{i}").alias("missing")) for i, f in enumerate(fields)]
    j = one.crossJoin(one_row(distinct_rows)).crossJoin(one_row(after))
    return j.select(F.col("_rows").alias("rows_before"), F.lit(len(fields)).alias("cols_before"),
                    "rows_after", (F.col("_rows") - F.col("_distinct")).alias("duplicates"),
                    F.explode(F.array(*structs)).alias("c")).select(
        "rows_before", "cols_before", "rows_after", "duplicates", "c.column", "c.dtype", "c.missing")
