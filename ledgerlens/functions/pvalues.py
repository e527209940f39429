"""p-values for the t distribution (trap T8).

SQL has no t distribution. The two-sided p-value of a t statistic with ``df`` degrees of
freedom is the regularised incomplete beta I_x(df/2, 1/2) at x = df / (df + t^2). It is
evaluated with the standard continued-fraction expansion (modified Lentz), vectorised over a
pandas batch and exposed as an Arrow ``pandas_udf``; it only ever runs on one-row results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300
_MAX_ITER = 300


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    cc, d = 1.0, 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAX_ITER + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        cc = 1.0 + aa / cc
        cc = _TINY if abs(cc) < _TINY else cc
        d = 1.0 / d
        h *= d * cc
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        cc = 1.0 + aa / cc
        cc = _TINY if abs(cc) < _TINY else cc
        d = 1.0 / d
        delta = d * cc
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) for a, b > 0 and 0 <= x <= 1."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t; NaN for undefined input."""
    if t is None or dof is None or not np.isfinite(dof) or dof <= 0 or (isinstance(t, float) and math.isnan(t)):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def _t_pvalue_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    vals = [t_two_sided_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b))
            for a, b in zip(t, dof)]
    return pd.Series(vals, dtype="float64").where(lambda s: ~s.isna(), None)


def t_pvalue(t: Column, dof: Column) -> Column:
    """Column expression: two-sided p-value of t with dof degrees of freedom (null if undefined)."""
    return _t_pvalue_udf(t.cast("double"), dof.cast("double"))
