from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tephra.errors import InsufficientEventsError, MarketDataError, UnknownStrategyError
from tephra.operators import events as e
from tests.helpers import values, weekly

D, BY = dt.date, ["series_id"]


def _z(x, m):
    past = pd.Series(x).shift(1)
    med = past.expanding(min_periods=m).median()
    mad = (past - med).abs().expanding(min_periods=m).median() * 1.4826
    return ((pd.Series(x) - med) / mad.where(mad > 0)).to_numpy()


def _planted(seed=3, n=120):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, n)
    x[[40, 80]] += 8
    x[60] -= 8
    return x


def test_causal_z_warm_up_and_gaps(spark):
    x = _planted()
    x[[5, 17, 70]] = np.nan
    got = values(e.causal_z(weekly(spark, {"value": x}), "value", 12, BY), "z")
    assert np.allclose(got, _z(x, 12), equal_nan=True)
    clean = values(e.causal_z(weekly(spark, {"value": _planted()}), "value", 12, BY), "z")
    assert np.isnan(clean[:23]).all() and not np.isnan(clean[23])


def test_scores_do_not_change_with_the_future(spark):
    x = _planted()
    whole = values(e.causal_z(weekly(spark, {"value": x}), "value", 12, BY), "z")
    part = values(e.causal_z(weekly(spark, {"value": x[:70]}), "value", 12, BY), "z")
    assert np.allclose(whole[:70], part, equal_nan=True)


def test_flat_series_have_no_score(spark):
    assert np.isnan(values(e.causal_z(weekly(spark, {"value": np.ones(40)}), "value", 5, BY), "z")).all()


def test_cusum_equals_a_loop(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 150)
    z[::11] = np.nan
    got = [r.cusum for r in e.cusum_flags(weekly(spark, {"z": z}), "z", 2.0, BY).orderBy("date").collect()]
    up = down = 0.0
    want = []
    for v in np.nan_to_num(z):
        up, down = max(0.0, up + v - 0.5), min(0.0, down + v + 0.5)
        want.append(up > 2 or down < -2)
        if up > 2:
            up = 0.0
        elif down < -2:
            down = 0.0
    assert got == want


def test_planted_events_and_screens(spark):
    x = _planted()
    cover, vent = np.full(120, 0.9), np.random.default_rng(1).normal(10, 1, 120)
    df = weekly(spark, {"residual": x, "cov": cover, "vent": vent})
    start = D(2019, 1, 6)
    found = {((r.date - start).days // 7, r.direction) for r in e.detect(df, "residual", BY, z_thresh=4.0).collect()}
    assert {(40, "surge"), (80, "surge"), (60, "drop")} <= found
    cover[40], vent[80] = 0.1, -20.0  # a gap in coverage, and stagnant air
    df = weekly(spark, {"residual": x, "cov": cover, "vent": vent})
    kept = {((r.date - start).days // 7, r.direction) for r in e.detect(df, "residual", BY, z_thresh=4.0, coverage="cov", vent="vent").collect()}
    assert (60, "drop") in kept and not {(40, "surge"), (80, "surge")} & kept
    with pytest.raises(UnknownStrategyError):
        e.detect(df, "residual", BY, method="magic")


def test_null_residual_has_few_events(spark):
    rng = np.random.default_rng(99)
    assert e.detect(weekly(spark, {"residual": rng.normal(size=120)}), "residual", BY, z_thresh=2.5).count() <= 6


def test_detector_both_names_its_source(spark):
    out = e.detect(weekly(spark, {"residual": _planted()}), "residual", BY, method="both").collect()
    assert {r.detector for r in out} <= {"both", "zscore", "cusum"}
    assert all(r.direction == ("surge" if r.z is not None and r.z >= 0 else "drop") for r in out)


def _greedy(events, production, window):
    used, out = set(), []
    for date, direction in sorted(events):
        want = {"surge": "up", "drop": "down"}[direction]
        near = [(abs((p - date).days), p) for p, d in production if d == want and (p, d) not in used and abs((p - date).days) <= window]
        if near:
            p = min(near)[1]
            used.add((p, want))
            out.append((date, p, direction, float((p - date).days)))
    return sorted(out)


def test_match_equals_greedy(spark):
    rng = np.random.default_rng(6)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(days=int(n))
    events = sorted({(day(n), ("surge", "drop")[n % 2]) for n in rng.integers(0, 300, 60)})
    production = sorted({(day(n), ("up", "down")[int(n % 3 == 0)]) for n in rng.integers(0, 300, 50)})
    a = spark.createDataFrame([("s", *x) for x in events], "series_id string, date date, direction string")
    b = spark.createDataFrame([("s", *x, "c") for x in production], "series_id string, date date, direction string, cause string")
    for window in (0, 3, 14):
        got = sorted((r.no2_date, r.prod_date, r.direction, r.lead_days) for r in e.match(a, b, window, BY).collect())
        assert got == _greedy(events, production, window)
    s = e.conclusion(e.match_summary(a, b, e.match(a, b, 14))).first()
    assert s.n_no2 == len(events) and s.n_prod == len(production) and abs(s.precision + s.false_discovery_rate - 1) < 1e-12
    none = e.conclusion(e.match_summary(a.limit(0), b, e.match(a.limit(0), b, 14))).first()
    assert none.precision is None and none.conclusion == "null"


def test_jump_events_skip_changes_over_holes(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(0, 0.1, 80))
    x[50:] += 5
    df = weekly(spark, {"value": x})
    found = {(r.date - D(2019, 1, 6)).days // 7: r.direction for r in e.jump_events(df, "value", BY, 4.0).collect()}
    assert found.get(50) == "up"
    x[49] = np.nan
    assert 50 not in {(r.date - D(2019, 1, 6)).days // 7 for r in e.jump_events(weekly(spark, {"value": x}), "value", BY, 4.0).collect()}


def test_calendar_edges_and_first_of_a_date(spark):
    cal = spark.sql("select date '2020-01-05' as `start`, date '2020-02-02' as `end`, 'down' as direction, 'cut' as cause")
    edges = {(r.date, r.direction, r.cause) for r in e.interval_edges(cal).collect()}
    assert edges == {(D(2020, 1, 5), "down", "cut"), (D(2020, 2, 2), "up", "cut_end")}
    jumps = spark.createDataFrame([(D(2020, 1, 5), "down", -3.0, "bf_rate")], "date date, direction string, z double, cause string")
    out = {(r.date, r.cause) for r in e.production_events(jumps, cal).collect()}
    assert out == {(D(2020, 1, 5), "bf_rate"), (D(2020, 2, 2), "cut_end")}


def test_market_study(spark):
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2020-01-01", periods=200)
    market = 100 * np.cumprod(1 + rng.normal(0, 0.001, 200))
    extra = np.zeros(200)
    events = [days[i].date() for i in (20, 60, 100, 140)]
    for i in (20, 60, 100, 140):
        extra[i + 2 : i + 8] = 0.01
    own = 100 * np.cumprod(1 + extra + np.r_[0, market[1:] / market[:-1] - 1])
    rows = [("M", d.date(), float(p)) for d, p in zip(days, market)] + [("X", d.date(), float(p)) for d, p in zip(days, own)]
    prices = spark.createDataFrame(rows, "symbol string, date date, close double")
    ar = e.abnormal_returns(prices, "M")
    ev = spark.createDataFrame([(d, "surge") for d in events] + [(D(2031, 1, 1), "drop")], "date date, direction string")
    cars = e.forward_car(ev, ar)
    frame = ar.toPandas().sort_values("date")
    for r in cars.collect():
        later = frame[pd.to_datetime(frame.date) >= pd.Timestamp(r.event_date) + pd.Timedelta(days=2)].abnormal_return[:5]
        assert (r.car is None) if not len(later) else abs(r.car - later.sum()) < 1e-9
    s = e.study(cars).join(e.mean_intervals(cars.where("car is not null"), "car", ["instrument"]), "instrument").first()
    assert s.n_events == 4 and s.hit_rate == 1.0 and 0.02 < s.ci_low <= s.car_mean <= s.ci_high
    assert e.market_verdict(spark.createDataFrame([s])).first().verdict == "market_signal"
    with pytest.raises(MarketDataError):
        e.abnormal_returns(prices, "ABSENT")


def test_no_return_over_a_hole(spark):
    rows = [("M", D(2020, 1, d), 100.0 + d) for d in (1, 2, 3, 4)] + [("X", D(2020, 1, d), 50.0 + d) for d in (1, 2, 4)]
    prices = spark.createDataFrame(rows, "symbol string, date date, close double")
    assert [r.date.day for r in e.abnormal_returns(prices, "M").orderBy("date").collect()] == [2]


def test_too_few_events(spark):
    with pytest.raises(InsufficientEventsError):
        e.enough_events(spark.range(3), 5)


def test_confirmed(spark):
    a = spark.createDataFrame([(D(2020, 1, 5), "surge"), (D(2020, 1, 12), "drop")], "date date, direction string")
    m = spark.createDataFrame([(D(2020, 1, 5),)], "no2_date date")
    assert [r.confirmed for r in e.confirm(a, m).orderBy("date").collect()] == [True, False]
