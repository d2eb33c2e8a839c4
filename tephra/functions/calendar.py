"""Period keys, steps between them and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tephra.errors import UnknownStrategyError

#: Periods of a year by frequency.
PERIODS = {"W": 52, "ME": 12, "D": 365}


def week_end(date: Column) -> Column:
    """The Sunday that ends the week of a date."""
    return F.next_day(F.date_sub(date.cast("date"), 1), "SUN")


_KEYS = {
    "W": week_end,
    "ME": lambda d: F.last_day(d.cast("date")),
    "MS": lambda d: F.trunc(d.cast("date"), "month"),
    "D": lambda d: d.cast("date"),
}


def period_key(date: Column, freq: str) -> Column:
    """The label of a date's period: its last day (W, ME), first day (MS) or itself (D)."""
    if freq not in _KEYS:
        raise UnknownStrategyError("frequency", freq, _KEYS)
    return _KEYS[freq](date)


def period_range(first: Column, last: Column, freq: str) -> Column:
    """All labels from one to another."""
    if freq not in _KEYS:
        raise UnknownStrategyError("frequency", freq, _KEYS)
    if freq == "ME":
        return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), F.last_day)
    return F.sequence(first, last, F.expr({"W": "interval 7 days", "MS": "interval 1 month", "D": "interval 1 day"}[freq]))


def heating_season(date: Column, months: tuple[int, ...]) -> Column:
    return F.month(date).isin(*months).cast("double")


def annual_phase(date: Column) -> Column:
    """Angle of the day in the year."""
    return F.lit(2 * 3.141592653589793) * F.dayofyear(date) / F.lit(365.25)


def observation_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HHmmss")


def processor_label(version: Column, date: Column) -> Column:
    """The recorded version, or the one that a date implies."""
    # Fixed value: the day on which the second version began.
    return F.coalesce(version, F.when(date.cast("date") < F.lit("2022-07-01").cast("date"), "v1.x").otherwise("v2.x"))


def snapshot_date(path: Column) -> Column:
    """The date in a snapshot's file name, NULL where there is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/]*$", 1), F.lit("")), "yyyy-MM-dd")
