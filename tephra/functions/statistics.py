"""Small statistics as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tephra.operators import kernels

#: Fixed value: two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def pearson(x: Column | str, y: Column | str, over=None) -> Column:
    """Correlation of complete pairs, by group or over a window; NULL, and no error in strict mode, without variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    own = (lambda e: e.over(over)) if over is not None else (lambda e: e)
    return own(F.covar_pop(a, b)) / F.nullif(own(F.stddev_pop(a)) * own(F.stddev_pop(b)), F.lit(0.0))


def fisher_low(r: Column, n: Column) -> Column:
    return F.when(n > 3, F.tanh(F.atanh(r) - F.lit(Z95) / F.sqrt(n - 3)))


def fisher_high(r: Column, n: Column) -> Column:
    return F.when(n > 3, F.tanh(F.atanh(r) + F.lit(Z95) / F.sqrt(n - 3)))


def t_of_r(r: Column, n: Column) -> Column:
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


@F.pandas_udf(DoubleType())
def p_of_r(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation on n - 2 degrees of freedom, NULL where there are none or abs(r) is 1."""
    return pd.Series(kernels.p_of_r(r.to_numpy(float), n.to_numpy(float)))


def block_length(n: Column) -> Column:
    """Length of resampled blocks: the rounded cube root, 2 at least and half the points at most."""
    root = F.bround(F.pow(n.cast("double"), F.lit(1 / 3))).cast("int")
    half = F.floor(n / 2).cast("int")
    return F.when(n < 4, F.greatest(F.lit(1), half)).otherwise(F.least(F.greatest(root, F.lit(2)), F.greatest(F.lit(2), half)))


def bar_class(r: Column, bar: tuple[float, float]) -> Column:
    low, high = bar
    return F.when(F.abs(r) >= high, "above-bar").when(F.abs(r) >= low, "in-band").otherwise("below-bar")


def sign_label(r: Column, significant: Column) -> Column:
    return F.when(~significant, "indeterminate").when(r > 0, "positive").otherwise("negative")


def lead_conclusion(significant: Column, peak_r: Column, peak_lag: Column, bar: tuple[float, float]) -> Column:
    return F.when(~significant | (F.abs(peak_r) < bar[0]), "null").when(peak_lag > 0, "lead").otherwise("concurrent")


def snr_ceiling(share: Column) -> Column:
    """The largest correlation that a signal with this share of the variance allows."""
    return F.sqrt(share)
