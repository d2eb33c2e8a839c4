from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tephra.errors import InsufficientDataError, TrendError, UnknownStrategyError
from tephra.operators import index as ix
from tephra.operators import kernels as k
from tephra.operators import trend as tr
from tephra.plans import pipelines as pl
from tests.helpers import values, weekly

BY = ["series_id"]


def test_weather_is_removed(spark):
    rng = np.random.default_rng(42)
    n = 104
    activity, wind, blh = rng.normal(size=n), rng.normal(5, 2, n), rng.normal(800, 100, n)
    signal = activity + 1.5 * wind - 0.01 * blh + 0.05 * rng.normal(size=n)
    signal[7] = np.nan
    df = weekly(spark, {"value": signal, "blh": blh, "wind_speed": wind})
    got = values(tr.regress_out(df, "value", ["blh", "wind_speed"], BY), "residual")
    ok = ~np.isnan(got)
    assert np.isnan(got[7]) and ok.sum() == n - 1 and np.corrcoef(got[ok], activity[ok])[0, 1] > 0.95
    smooth = values(tr.regress_out(df, "value", ["blh", "wind_speed"], BY, "loess"), "residual")
    assert np.corrcoef(smooth[ok], activity[ok])[0, 1] > 0.5
    short = weekly(spark, {"value": signal[:3], "blh": blh[:3], "wind_speed": wind[:3]})
    assert np.allclose(values(tr.regress_out(short, "value", ["blh", "wind_speed"], BY), "residual"), signal[:3])
    with pytest.raises(UnknownStrategyError):
        tr.regress_out(df, "value", ["blh"], BY, "cubic")


def test_one_covariate_in_sql_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=50), rng.normal(size=50)
    x[3], y[9] = np.nan, np.nan
    df = weekly(spark, {"y": y, "x": x})
    a = values(ix.residual_simple(df, "y", "x", BY), "residual")
    b = values(tr.regress_out(df, "y", ["x"], BY), "residual")
    assert np.allclose(a, b, equal_nan=True)


def test_trend_recovers_the_plan_and_keeps_gaps(spark):
    rng = np.random.default_rng(7)
    t = np.linspace(0, 1, 120)
    plan = 100 - 55 * t
    y = plan + 6 * np.sin(24 * np.pi * t) + 0.3 * rng.normal(size=120)
    y[30:33] = np.nan
    out = tr.intensity_trend(weekly(spark, {"value": y}), "value", BY)
    row = out.first()
    trend, residual = values(out, "trend_s_t"), values(out, "residual_activity")
    ok = ~np.isnan(y)
    assert row.df <= 4 and row.status == "ok" and np.isnan(trend[30:33]).all()
    assert np.abs(trend[ok] - plan[ok]).max() < 5 and np.allclose(residual[ok], y[ok] - trend[ok])


def test_degenerate_fits_are_refused_and_stop_no_other_series(spark):
    y = np.random.default_rng(0).normal(size=30)
    for bad in ({"grid": ()}, {"folds": 1}, {"least": 31}, {"folds": 31}, {"criterion": "gcv", "estimator": "loess"}):
        with pytest.raises(TrendError):
            tr.choose_trend(y, **bad)
    with pytest.raises(UnknownStrategyError):
        tr.choose_trend(y, estimator="kernel")
    df = weekly(spark, {"value": y}).union(weekly(spark, {"value": y[:5]}, key="short"))
    status = {r.series_id: r.status for r in tr.intensity_trend(df, "value", BY).select("series_id", "status").distinct().collect()}
    assert status["signal"] == "ok" and "24" in status["short"]


def test_spline_design():
    t = np.linspace(0, 1, 9)
    assert [k.spline_design(t, d).shape[1] for d in (1, 2, 3, 4, 6)] == [1, 2, 3, 4, 6]
    assert np.allclose(k.spline_design(t, 6)[:, 5], np.maximum(t - 2 / 3, 0) ** 3)
    y = 1 + 2 * t - t**2
    assert np.allclose(k.smooth(t, y, t, 3, "spline"), y)


def test_lowess_is_exact_on_lines_and_robust():
    x = np.sort(np.random.default_rng(1).uniform(0, 10, 80))
    assert np.allclose(k.lowess(x, 2 + 3 * x, 0.4), 2 + 3 * x)
    y = np.sin(x)
    y[40] += 50
    assert np.abs(k.lowess(x, y, 0.2) - np.sin(x)).max() < 0.5


def test_seasonal_trend_separates():
    t = np.arange(156.0)
    y = 10 + t / 15 + 5 * np.sin(2 * np.pi * t / 52)
    season, trend = k.seasonal_trend(y, 52)
    assert np.abs(y - season - trend).max() < 0.3 and np.ptp(season) > 8 and abs(np.polyfit(t, trend, 1)[0] - 1 / 15) < 0.01


def test_deseason_methods(spark):
    t = np.arange(156.0)
    y = 10 + t / 15 + 5 * np.sin(2 * np.pi * t / 52)
    y[20] = np.nan
    df = weekly(spark, {"value": y})
    yoy = values(ix.deseasonalise(df, "value", BY, "yoy"), "deseasoned")
    assert np.allclose(yoy, pd.Series(y).diff(52), equal_nan=True)
    double = values(ix.deseasonalise(df, "value", BY, "yoy-double-diff"), "deseasoned")
    assert np.allclose(double, pd.Series(y).diff(52).diff(), equal_nan=True)
    for method in ("stl", "intensity-model", "harmonic", "prophet", "none"):
        out = values(ix.deseasonalise(df, "value", BY, method), "deseasoned")
        assert np.isnan(out[20]) and (~np.isnan(out)).sum() == 155
        if method in ("stl", "harmonic"):
            assert np.nanstd(out) < 1
    assert np.isnan(values(ix.deseasonalise(weekly(spark, {"value": y[:60]}), "value", BY, "stl"), "deseasoned")).all()
    with pytest.raises(UnknownStrategyError):
        ix.deseasonalise(df, "value", BY, "magic")


def test_harmonic_in_sql_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    dates = pd.date_range("2019-01-01", periods=700, freq="D")
    y = 6 * np.cos(2 * np.pi * dates.dayofyear / 365.25) + rng.normal(size=700)
    y = np.where(rng.random(700) < 0.2, np.nan, y)
    got = values(ix.harmonic_one(weekly(spark, {"value": y}, "2019-01-01", freq="D"), "value", BY), "residual")
    ok = ~np.isnan(y)
    want = np.full(700, np.nan)
    want[ok] = k.residual_of(k.harmonics(2 * np.pi * dates.dayofyear.to_numpy()[ok] / 365.25, 1), y[ok])
    assert np.allclose(got, want, equal_nan=True)


def _daily(n=800):
    rng = np.random.default_rng(0)
    i = np.arange(n)
    dates = pd.date_range("2021-01-01", periods=n, freq="D")
    activity = 5 * np.sin(2 * np.pi * i / 40)
    y = 100 - 0.03 * i + 8 * np.sin(2 * np.pi * dates.dayofyear / 365.25) + np.where(dates.dayofweek >= 5, -3, 1.2) + activity + rng.normal(0, 0.5, n)
    y = np.where(rng.random(n) < 0.25, np.nan, y)
    return np.asarray(y, float), activity


def test_additive_model_finds_the_activity(spark):
    y, activity = _daily()
    out = tr.additive_deseason(weekly(spark, {"value": y}, "2021-01-01", freq="D"), "value", BY)
    residual, week = values(out, "residual"), values(out, "weekly")
    ok = ~np.isnan(y)
    assert np.array_equal(np.isnan(residual), ~ok) and np.corrcoef(residual[ok], activity[ok])[0, 1] > 0.8
    assert 3 < np.nanmax(week) - np.nanmin(week) < 6
    with pytest.raises(InsufficientDataError):
        tr.additive_parts(y[:100], pd.Series(pd.date_range("2021-01-01", periods=100)))


def test_causal_residuals_do_not_change_with_the_future(spark):
    y, _ = _daily(400)
    how = {"min_train": 200, "refit_every": 30}
    whole = values(tr.additive_causal(weekly(spark, {"value": y}, "2021-01-01", freq="D"), "value", BY, **how), "residual_causal")
    part = values(tr.additive_causal(weekly(spark, {"value": y[:340]}, "2021-01-01", freq="D"), "value", BY, **how), "residual_causal")
    first = int(np.flatnonzero(~np.isnan(y))[200])
    assert np.isnan(whole[:first]).all() and not np.isnan(whole[first])
    assert np.allclose(whole[:340], part, equal_nan=True)


def test_index_and_terms(spark):
    y = np.array([1.0, 2.0, np.nan, 6.0])
    df = weekly(spark, {"value": y})
    z = values(ix.build_index(df, "value", BY), "index_value")
    assert np.allclose(z, (y - 3) / np.nanstd(y), equal_nan=True)
    assert np.allclose(values(ix.build_index(df, "value", BY, "2019-01-06"), "index_value"), y * 100, equal_nan=True)
    assert np.allclose(values(ix.build_index(df, "value", BY, "1900"), "index_value"), y / 3 * 100, equal_nan=True)
    assert np.allclose(values(ix.build_index(weekly(spark, {"value": np.ones(4)}), "value", BY), "index_value"), 0)
    year = np.random.default_rng(0).normal(size=60)
    one = values(ix.without_heating(weekly(spark, {"value": year}), "value", (11, 12, 1, 2, 3), BY), "value")
    months = pd.date_range("2019-01-06", periods=60, freq="W-SUN").month
    heating = np.isin(months, (11, 12, 1, 2, 3)).astype(float)
    assert np.allclose(one, tr.structural_residual(year, heating[:, None]))
    assert np.allclose(values(ix.without_heating(weekly(spark, {"value": year[:6]}), "value", (1, 2), BY), "value"), year[:6])


def test_intervals_become_days(spark):
    cal = spark.sql("select date '2019-01-10' as `start`, date '2019-01-20' as `end`")
    out = values(ix.in_interval(weekly(spark, {"value": np.zeros(4)}), cal), "curtailment")
    assert out.tolist() == [0, 1, 1, 0]
    assert np.isnan(values(ix.in_interval(weekly(spark, {"value": np.zeros(2)}), None), "curtailment")).all()


def test_validation_end_to_end(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=120)
    y = np.r_[rng.normal(size=3), 2 * x[:-3]] + 0.1 * rng.normal(size=120)
    index = weekly(spark, {"index_value": x, "valid_coverage": np.full(120, 0.9)}).drop("series_id")
    target = weekly(spark, {"value": y}).drop("series_id")
    out = pl.validate(index, target)
    assert out["peak_lag"] == 3 and out["bar"] == "above-bar" and len(out["ccf"]) == 17 and out["conclusion"] in ("lead", "null")
    assert "conclusion" in pl.validation_summary(out)
    with pytest.raises(Exception):
        pl.validate(index.limit(10), target)


def test_activity_index_end_to_end(spark):
    rng = np.random.default_rng(3)
    n = 130
    s = weekly(spark, {"no2_corrected": rng.normal(size=n), "valid_coverage": np.full(n, 0.9)}).drop("series_id")
    meteo = weekly(spark, {"u10": rng.normal(size=n), "blh": rng.normal(size=n)}).drop("series_id")
    out = values(pl.activity_index(s, meteo), "index_value")
    assert np.isnan(out[:52]).all() and abs(np.nanmean(out)) < 1e-9 and abs(np.nanstd(out) - 1) < 1e-9


def test_catalyst_end_to_end(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=160)
    for i in (40, 60, 80, 100, 120, 140):
        x[i] += 9
    residual = weekly(spark, {"residual_activity": x, "valid_coverage": np.full(160, 0.9)})
    level = np.zeros(160)
    for i in (40, 60, 80, 100, 120, 140):
        level[i + 1 :] += 30
    target = weekly(spark, {"value": level + rng.normal(0, 0.5, 160)})
    out = pl.catalyst(residual, target)
    row = out["summary"].first()
    assert row.n_matched >= 5 and row.median_lead_days == 7 and out["events"].where("confirmed").count() >= 5
    with pytest.raises(Exception):
        pl.catalyst(residual.limit(30), target)


def test_scale_signal_falls_back(spark):
    rows = [(dt.date(2020, 1, 5) + dt.timedelta(days=7 * w), y, x, 40.1 - 0.15 * y, 117.9 + 0.15 * x, float(w + x), 1.0) for w in range(3) for y in range(8) for x in range(8)]
    cube = spark.createDataFrame(rows, "period date, iy int, ix int, lat double, lon double, value double, coverage double")
    fac = spark.createDataFrame([("a", 39.5, 118.3, "x", "operating")], "name string, latitude double, longitude double, technology string, status string")
    assert pl.scale_signal(cube, fac, 0.25, least_cells=1).first().label == "footprint"
    assert pl.scale_signal(cube, fac, 0.25, least_cells=50).first().label == "aoi-mean-fallback"


def test_sweep_makes_equal_blocks_once(spark, monkeypatch):
    """Resolutions of the same blocks share a signal and its draws, and each has its rows."""
    weeks = [dt.date(2020, 1, 5) + dt.timedelta(days=7 * w) for w in range(40)]
    rng = np.random.default_rng(3)
    level = rng.normal(size=40)
    rows = [(d, y, x, 40.1 - 0.15 * y, 117.9 + 0.15 * x, float(v * (y + x)), 1.0) for d, v in zip(weeks, level, strict=True) for y in range(8) for x in range(8)]
    cube = spark.createDataFrame(rows, "period date, iy int, ix int, lat double, lon double, value double, coverage double")
    fac = spark.createDataFrame([("a", 39.5, 118.3, "x", "operating")], "name string, latitude double, longitude double, technology string, status string")
    target = spark.createDataFrame([(d, float(v + e)) for d, v, e in zip(weeks, level, rng.normal(size=40), strict=True)], "date date, value double")
    made, one = [], pl.scale_signal
    monkeypatch.setattr(pl, "scale_signal", lambda *a, **k: made.append(a[2:5]) or one(*a, **k))
    found = pl.scale_sweep(cube, target, fac, (0.25,), ("native", 0.10, 0.15, 0.30), ("level",), ("W",), 1, draws_boot=20, draws_perm=20).where("lag_kind = 'lag0'").collect()
    assert made == [(0.25, 1, 1), (0.25, 2, 2)]
    by = {r.resolution: r for r in found}
    assert len(found) == 4 and set(by) == {"native", "0.1", "0.15", "0.3"}
    assert by["native"].r == by["0.1"].r == by["0.15"].r and by["native"].p_perm == by["0.1"].p_perm and by["native"].r != by["0.3"].r


def test_calendar_days_beyond_nanoseconds():
    """Grids of one day each from 2020 on pass 2262 after 88,500 days, where timestamps of nanoseconds end."""
    late = pd.Series([dt.date(2300, 1, 1) + dt.timedelta(days=7 * w) for w in range(60)])
    early = pd.Series([dt.date(1900, 1, 1) + dt.timedelta(days=7 * w) for w in range(60)])  # the same days of the year
    y = np.random.default_rng(5).normal(size=60)
    assert np.allclose(tr.harmonic_residual(y, late), tr.harmonic_residual(y, early))


def test_findings_compute_the_sweep_once(spark, monkeypatch):
    """All rows and those of the native grid meet in a join, which computed the resampling twice."""
    from tephra.plans import q_models

    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(0.25, r, "W", v, "lag0", s * 0.5, "robust") for r, s in (("native", 1), ("0.3", -1)) for v in ("level", "yoy")], "buffer double, resolution string, freq string, variant string, lag_kind string, r double, verdict string")

    def counted(pdf):
        seen.add(len(pdf))
        return pdf

    monkeypatch.setattr(q_models, "_sweep", lambda spark, d: rows.groupBy("resolution", "variant").applyInPandas(counted, rows.schema))
    out = {r.resolution: (r.n, r.robust, r.sign_changes) for r in q_models.scale_findings(spark, "").collect()}
    assert out == {"native": (2, 2, 0), "0.3": (2, 2, 2)} and seen.value == 4
