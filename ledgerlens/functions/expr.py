"""Column-expression helpers (K01-K05, T1/T2 guards, H01 date parsing).

Everything here returns a ``Column`` built from built-in functions, so it stays inside
whole-stage codegen and never leaves the JVM.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def qcol(name: str) -> Column:
    """Column by exact name even when it has spaces or dots."""
    return F.col(f"`{name}`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


# ---------------------------------------------------------------- guards

def safe_div(a, b) -> Column:
    """A / b as double, 0 when the divisor is 0, null or NaN (ANSI-safe)."""
    a, b = c(a).cast("double"), c(b).cast("double")
    q = F.try_divide(a, F.when(F.isnan(b), F.lit(None)).otherwise(b))
    return clean_num(q)


def ratio_or_null(a, b) -> Column:
    """a / b as double, null when the divisor is 0 or null."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def clean_num(x) -> Column:
    """NaN, +-Infinity and null -> 0."""
    x = c(x).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def nan_to_null(x) -> Column:
    x = c(x)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def normalize_missing(df: DataFrame) -> DataFrame:
    """Pandas treats NaN as missing; Spark does not. Map NaN -> null on float columns."""
    cols = [nan_to_null(qcol(f.name)).alias(f.name) if is_float(f.dataType) else qcol(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def pct_change(cur, prev) -> Column:
    """(cur - prev) / |prev| * 100; null when prev is 0 or null."""
    return F.try_divide((c(cur) - c(prev)).cast("double"), F.abs(c(prev)).cast("double")) * 100.0


# ---------------------------------------------------------------- formatting

# Currency symbol and magnitude suffixes used by the dashboards.
RUPEE = "₹"
CRORE, LAKH, THOUSAND = 1e7, 1e5, 1e3


def _fmt_fixed(x: Column, dp: int) -> Column:
    return F.format_string(f"%.{dp}f", x)


def fmt_inr(x, style: str = "dashboard", symbol: str = RUPEE) -> Column:
    """Compact rupee label.

    ``dashboard``: 1 dp Cr, 2 dp L, 1 dp K, integer with thousands separators below 1,000
    (no sign handling, like the dashboard cards). ``report``: signed, 2 dp Cr/L, 1 dp K, 0 dp.
    """
    v = c(x).cast("double")
    if style == "dashboard":
        return (F.when(v.isNull() | F.isnan(v), F.lit("—"))
                .when(v >= CRORE, F.concat(F.lit(symbol), _fmt_fixed(v / CRORE, 1), F.lit("Cr")))
                .when(v >= LAKH, F.concat(F.lit(symbol), _fmt_fixed(v / LAKH, 2), F.lit("L")))
                .when(v >= THOUSAND, F.concat(F.lit(symbol), _fmt_fixed(v / THOUSAND, 1), F.lit("K")))
                .otherwise(F.concat(F.lit(symbol), F.format_number(v.cast("long"), 0))))
    a = F.abs(v)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    body = (F.when(a >= CRORE, F.concat(_fmt_fixed(a / CRORE, 2), F.lit("Cr")))
            .when(a >= LAKH, F.concat(_fmt_fixed(a / LAKH, 2), F.lit("L")))
            .when(a >= THOUSAND, F.concat(_fmt_fixed(a / THOUSAND, 1), F.lit("K")))
            .otherwise(F.format_number(a, 0)))
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit("N/A")).otherwise(F.concat(sign, F.lit(symbol), body))


def fmt_pct(x, signed: bool = False) -> Column:
    """One-decimal percent, optional leading + for non-negative values."""
    v = c(x).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    sign = F.when(v >= 0, F.lit("+")).otherwise(F.lit("")) if signed else F.lit("")
    return F.when(bad, F.lit("N/A")).otherwise(F.concat(sign, _fmt_fixed(v, 1), F.lit("%")))


def change_label(cur, prev, suffix: str = "WoW") -> Column:
    """Arrow + 1-dp change vs previous; previous 0 -> '+0.0%'."""
    cur, prev = c(cur).cast("double"), c(prev).cast("double")
    chg = (cur - prev) / F.abs(prev) * 100.0
    arrow = F.when(chg >= 0, F.lit("↑")).otherwise(F.lit("↓"))
    return F.when(prev == 0, F.lit("+0.0%")).otherwise(
        F.concat(arrow, F.lit(" "), _fmt_fixed(F.abs(chg), 1), F.lit(f"% {suffix}")))


# ---------------------------------------------------------------- dates

# The date layouts accepted by the mixed-format parser, tried in this order.
DATE_FORMATS_MONTH_FIRST = [
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd/MM/yyyy", "dd MMM yyyy",
    "MMM dd yyyy", "MMM dd, yyyy", "MMM yyyy", "yyyy-MM",
]
DATE_FORMATS_DAY_FIRST = [
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "dd MMM yyyy",
    "MMM dd yyyy", "MMM dd, yyyy", "MMM yyyy", "yyyy-MM",
]


#: What each part of a layout can look like: at least every text that the layout itself accepts there.
_SHAPES = {"yyyy": r"[+-]?\d{4,}", "MMM": r"\D+", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}",
           "ss": r"\d{2}", "'T'": r"\D"}


def _shape(layout: str) -> str | None:
    """A regular expression that every text of the date layout matches; None if the layout has parts not listed."""
    parts = re.findall(r"([A-Za-z])(\1*)|('[^']*')|([-/:, ])|(.)", layout)
    found = [re.escape(mark) if mark else _SHAPES.get(first + more or quoted) for first, more, quoted, mark, _ in parts]
    return None if None in found else "".join(found)


def parse_dates(x, dtype: T.DataType | None = None, dayfirst: bool = False,
                formats: list[str] | None = None) -> Column:
    """Mixed-format parse to timestamp; anything unparseable -> null.

    Timestamps pass through; strings are trimmed and tried against an ordered format list with
    ``try_to_timestamp`` so ANSI mode never raises. A parse that fails costs far more than a look at the text, so a
    layout is tried only on texts of its shape.
    """
    col = c(x)
    if dtype is not None and is_temporal(dtype):
        return col.cast("timestamp")
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp")
    fmts = formats or (DATE_FORMATS_DAY_FIRST if dayfirst else DATE_FORMATS_MONTH_FIRST)
    s = F.trim(col.cast("string"))
    shapes = {f: _shape(f) for f in fmts}
    attempts = [F.when(s.rlike(f"^{shapes[f]}\\z"), F.try_to_timestamp(s, F.lit(f))) if shapes[f]
                else F.try_to_timestamp(s, F.lit(f)) for f in fmts]
    parsed = F.coalesce(*attempts)
    if None in shapes.values():
        return parsed
    fits = s.rlike(f"^(?:{'|'.join(dict.fromkeys(shapes.values()))})\\z")
    if all("yyyy" in f for f in fmts):
        fits = s.rlike(r"\d{4}") & fits
    return F.when(fits, parsed)


# ---------------------------------------------------------------- numbers

#: The texts that a cast to double accepts (the grammar of Java's Double.valueOf, and Spark's names of the special values).
NUMBER_TEXT = (r"^[\x00-\x20]*[+-]?(?:(?i:nan|inf|infinity)|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?"
               r"|0[xX](?:[0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?\d+[fFdD]?)[\x00-\x20]*\z")


def to_number(x) -> Column:
    """Text to double, null if it is none; only texts that look like a number are cast, as a cast that fails costs far
    more than a look."""
    s = c(x).cast("string")
    return F.when(s.rlike(NUMBER_TEXT), s.try_cast("double"))


# ---------------------------------------------------------------- text

def regex_escape(text: str) -> str:
    """Literal search helper (Java regex quoting)."""
    return re.escape(text)


def contains_ci(x, pattern: str) -> Column:
    """Case-insensitive regex containment, null -> false (pandas ``str.contains(case=False, na=False)``)."""
    return F.coalesce(c(x).cast("string").rlike("(?i)" + pattern), F.lit(False))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)
