from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.errors import AlignmentError, UnknownStrategyError
from tephra.functions import cleaning as cl
from tephra.functions.calendar import snapshot_date
from tephra.operators import series as op
from tests.helpers import values, weekly

D = dt.date


def _days(spark, rows):
    return spark.createDataFrame(rows, "series_id string, date date, value double")


def test_week_ends_sunday_and_gaps_are_rows(spark):
    df = _days(spark, [("a", D(2020, 1, 6), 1.0), ("a", D(2020, 1, 12), 3.0), ("a", D(2020, 1, 27), 5.0)])
    out = op.resample(df, "W", ["value"], ["series_id"]).orderBy("date").collect()
    assert [(r.date, r.value) for r in out] == [(D(2020, 1, 12), 2.0), (D(2020, 1, 19), None), (D(2020, 1, 26), None), (D(2020, 2, 2), 5.0)]


def test_month_gaps(spark):
    df = _days(spark, [("a", D(2020, 1, 6), 1.0), ("a", D(2020, 4, 2), 3.0), ("b", D(2020, 2, 1), 7.0)])
    out = op.resample(df, "ME", ["value"], ["series_id"]).orderBy("series_id", "date").collect()
    assert [(r.series_id, r.date, r.value) for r in out] == [("a", D(2020, 1, 31), 1.0), ("a", D(2020, 2, 29), None), ("a", D(2020, 3, 31), None), ("a", D(2020, 4, 30), 3.0), ("b", D(2020, 2, 29), 7.0)]


def test_all_null_period_stays_null(spark):
    df = _days(spark, [("a", D(2020, 1, 6), None), ("a", D(2020, 1, 14), 2.0)])
    assert [r.value for r in op.resample(df, "W", ["value"], ["series_id"]).orderBy("date").collect()] == [None, 2.0]


def test_unknown_frequency(spark):
    with pytest.raises(UnknownStrategyError):
        op.resample(_days(spark, []), "Q", ["value"])


def test_dedup_keeps_the_last_line(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (3, "y", 3.0)], "line int, k string, v double")
    assert sorted(r.v for r in op.dedup(df, ["k"], [F.desc("line")]).collect()) == [2.0, 3.0]


def test_shift_and_pct_change_keep_holes(spark):
    df = weekly(spark, {"value": np.array([1.0, np.nan, 4.0, 8.0])})
    assert np.array_equal(values(op.pct_change(df, "value", ["series_id"]), "ret"), [np.nan, np.nan, np.nan, 1.0], equal_nan=True)
    assert np.array_equal(values(op.shift(df, "value", -1, ["series_id"]), "value"), [np.nan, 4.0, 8.0, np.nan], equal_nan=True)


def test_rolling_correlation_needs_a_full_window(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=30), rng.normal(size=30)
    y[10] = np.nan
    got = values(op.rolling_corr(weekly(spark, {"x": x, "y": y}), "x", "y", 6, ["series_id"]), "r")
    want = np.full(30, np.nan)
    for i in range(5, 30):
        if not np.isnan(y[i - 5 : i + 1]).any():
            want[i] = np.corrcoef(x[i - 5 : i + 1], y[i - 5 : i + 1])[0, 1]
    assert np.allclose(got, want, equal_nan=True)


def test_outer_align_and_align(spark):
    a = weekly(spark, {"x": np.array([1.0, 2.0, 3.0])}).drop("series_id")
    b = weekly(spark, {"y": np.array([5.0, np.nan])}, start="2019-01-13").drop("series_id")
    assert op.outer_align([a, b]).count() == 3
    assert [(r.x, r.y) for r in op.align(a, b).collect()] == [(2.0, 5.0)]


def test_melt_then_pivot_is_identity(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1.0, None), (D(2020, 1, 2), 2.0, 3.0)], "date date, a double, b double")
    long = op.melt(df, ["date"], ["a", "b"], "symbol", "close")
    assert long.count() == 3
    back = op.pivot_last(long, ["date"], "symbol", ["a", "b"], "close", "date").orderBy("date").collect()
    assert [(r.a, r.b) for r in back] == [(1.0, None), (2.0, 3.0)]


def test_month_batches_are_contiguous(spark):
    out = op.month_batches(spark.sql("select date '2019-01-15' first, date '2019-04-01' last")).orderBy("start").collect()
    assert [(r.start, r.stop) for r in out] == [(D(2019, 1, 15), D(2019, 2, 1)), (D(2019, 2, 1), D(2019, 3, 1)), (D(2019, 3, 1), D(2019, 4, 1))]


def test_cleaning(spark):
    df = spark.createDataFrame([(" 70.50 ", 0.1), ("0.00", None), ("n/a", 0.5), (None, float("nan"))], "t string, c double")
    out = df.select(cl.number(F.col("t")).alias("v"), cl.coverage_screen(F.lit(1.0), F.col("c"), 0.25).alias("s"), cl.missing(F.col("c")).alias("m")).collect()
    assert [r.v for r in out] == [70.5, None, None, None]
    assert [r.s for r in out[:3]] == [None, 1.0, 1.0] and out[3].m is None


def test_pick_column(spark):
    with pytest.raises(AlignmentError):
        cl.pick_column(spark.range(1), cl.PREDICTORS, "predictor")
    assert cl.pick_column(spark.range(1).withColumn("no2_corrected", F.lit(1)), cl.PREDICTORS, "predictor") == "no2_corrected"


def test_snapshot_date(spark):
    df = spark.createDataFrame([("/a/wind_2024-03-05.csv",), ("/2020-01-01/none.csv",)], "p string")
    assert [r[0] for r in df.select(snapshot_date(F.col("p"))).collect()] == [D(2024, 3, 5), None]
