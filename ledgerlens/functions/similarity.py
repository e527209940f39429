"""Ratcliff-Obershelp similarity (``difflib.SequenceMatcher.ratio``) as an Arrow pandas UDF.

It only runs on candidate pairs that survived exact, lossless prunes (length and character
multiset bounds), never on all pairs.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import c


@F.pandas_udf(T.DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
        else:
            out.append(difflib.SequenceMatcher(None, x, y).ratio())
    return pd.Series(out, dtype="float64")


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """``SequenceMatcher(None, a, b).ratio()`` (not symmetric in general: a is sequence 1)."""
    return _ratio_udf(c(a).cast("string"), c(b).cast("string"))
