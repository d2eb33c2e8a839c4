"""Turning raw text and sentinels into values or NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.errors import AlignmentError, ColumnError

PREDICTORS = ("index_value", "no2_attributed", "no2_corrected")
TARGETS = ("value", "operating_rate")


def number(text: Column) -> Column:
    """A number, NULL where the text is none or the placeholder 0."""
    return F.nullif(F.trim(text.cast("string")).try_cast("double"), F.lit(0.0))


def missing(value: Column) -> Column:
    """NULL in place of NaN."""
    return F.when(~F.isnan(value), value)


def quality_mask(value: Column, quality: Column, threshold: float) -> Column:
    return F.when(quality >= threshold, value)


def coverage_screen(value: Column, coverage: Column, least: float) -> Column:
    """NULL where coverage is known and too low; unknown coverage passes."""
    return F.when(coverage.isNull() | (coverage >= least), value)


def pick_column(df: DataFrame, candidates: Sequence[str], role: str) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise AlignmentError(f"no {role} column; one of {', '.join(candidates)} is needed")


def require(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ColumnError(f"{what} lacks {', '.join(lacking)}")
    return df
