"""Dated series: (keys, date, values). Gaps are NULL rows and are never filled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.functions.calendar import period_key, period_range
from tephra.functions.statistics import pearson

MEAN = "mean"
_HOW = {MEAN: F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def ordered(by: Sequence[str], date: str = "date"):
    return Window.partitionBy(*by).orderBy(date)


def with_gaps(df: DataFrame, freq: str, by: Sequence[str], date: str = "date") -> DataFrame:
    """Adds the periods that are missing between a series' first and last, with NULL values.

    Each row spans the labels up to the next row, so the series is read once and joined with nothing.
    """
    timed = df.withColumn("__after", F.lead(date).over(ordered(by, date)))
    until = F.date_sub(F.trunc("__after", "month") if freq == "ME" else F.col("__after"), 1)
    labels = period_range(F.col(date), F.coalesce(until, F.col(date)), freq)
    spread = timed.withColumn("__label", F.explode(labels))
    values = [F.when(F.col("__label") == F.col(date), F.col(c)).alias(c) for c in df.columns if c not in (*by, date)]
    return spread.select(*by, F.col("__label").alias(date), *values)


def resample(df: DataFrame, freq: str, values: Mapping[str, str] | Sequence[str], by: Sequence[str] = (), date: str = "date", gaps: bool = True) -> DataFrame:
    """One row a period. values: columns, averaged over what isn't NULL, or a map from column to the way."""
    how = values if isinstance(values, Mapping) else dict.fromkeys(values, MEAN)
    out = df.groupBy(*by, period_key(F.col(date), freq).alias(date)).agg(*[_HOW[h](c).alias(c) for c, h in how.items()])
    return with_gaps(out, freq, by, date) if gaps else out


def resample_last(df: DataFrame, freq: str, value: str, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """The latest value of each period."""
    out = df.where(F.col(value).isNotNull()).groupBy(*by, period_key(F.col(date), freq).alias("__period")).agg(F.max_by(value, date).alias(value))
    return with_gaps(out.withColumnRenamed("__period", date), freq, by, date)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the order given, which must not tie."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def shift(df: DataFrame, value: str, k: int, by: Sequence[str] = (), date: str = "date", name: str | None = None) -> DataFrame:
    """The value k rows before (after, if k < 0)."""
    w = ordered(by, date)
    return df.withColumn(name or value, F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w))


def difference(df: DataFrame, value: str, k: int = 1, by: Sequence[str] = (), date: str = "date", name: str | None = None) -> DataFrame:
    return df.withColumn(name or value, F.col(value) - F.lag(value, k).over(ordered(by, date)))


def pct_change(df: DataFrame, value: str, by: Sequence[str] = (), date: str = "date", name: str = "ret") -> DataFrame:
    """Relative change from the row before; NULL across a hole, which isn't filled."""
    return df.withColumn(name, F.col(value) / F.nullif(F.lag(value).over(ordered(by, date)), F.lit(0.0)) - 1)


def align(left: DataFrame, right: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    """Rows that both have, without NULLs."""
    return left.join(right, list(on)).na.drop()


def outer_align(frames: Sequence[DataFrame], on: Sequence[str] = ("date",)) -> DataFrame:
    """All dates of several frames side by side: one union and one aggregation, not a chain of outer joins."""
    names = [[c for c in f.columns if c not in on] for f in frames]
    every = [c for own in names for c in own]
    stacked = None
    for f in frames:
        part = f.select(*on, *[(F.col(c) if c in f.columns else F.lit(None).cast("double")).alias(c) for c in every])
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*on).agg(*[F.max(c).alias(c) for c in every])


def rolling_corr(df: DataFrame, x: str, y: str, width: int, by: Sequence[str] = (), date: str = "date", name: str = "r") -> DataFrame:
    """Correlation over the last `width` rows, NULL until as many complete pairs are there."""
    w = ordered(by, date).rowsBetween(1 - width, 0)
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    return df.withColumn(name, F.when(F.count(both).over(w) == width, pearson(x, y, w)))


def climatology(df: DataFrame, value: str, part: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean by a part of the calendar."""
    return df.groupBy(*by, part.alias(name)).agg(F.avg(value).alias("effect"))


def melt(df: DataFrame, ids: Sequence[str], names: Sequence[str], key: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(names), key, value).where(F.col(value).isNotNull())


def pivot_last(df: DataFrame, rows: Sequence[str], key: str, names: Sequence[str], value: str, order: str) -> DataFrame:
    """One column for each name: the value that comes last in the order. Names are given, so nothing is scanned for them."""
    return df.groupBy(*rows).agg(*[F.max_by(F.when(F.col(key) == n, F.col(value)), F.when(F.col(key) == n, F.col(order))).alias(n) for n in names])


def completeness(df: DataFrame, first: str, last: str, freq: str, date: str = "date", coverage: str = "coverage") -> DataFrame:
    """Share of the expected periods that carry any coverage, 1 at most."""
    expected = F.size(period_range(period_key(F.lit(first), freq), period_key(F.lit(last), freq), freq))
    have = F.count_distinct(F.when(F.col(coverage).isNotNull(), F.col(date)))
    return df.agg(have.alias("have")).select(F.col("have"), expected.cast("long").alias("expected"), F.least(F.col("have") / expected, F.lit(1.0)).alias("fraction"))


def month_batches(df: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Contiguous half-open month ranges from a first day to a last: (start, stop)."""
    starts = F.transform(F.sequence(F.trunc(first, "month"), F.col(last), F.expr("interval 1 month")), lambda d: F.greatest(d, F.col(first)))
    out = df.select(F.posexplode(starts).alias("i", "start"), F.col(last).alias("__last"))
    return out.where(F.col("start") < F.col("__last")).select("start", F.least(F.add_months(F.trunc("start", "month"), 1), F.col("__last")).alias("stop"))
