"""Operators that fit a model to each series: grouped functions over numpy kernels, one task a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.errors import InsufficientDataError, TrendError, UnknownStrategyError
from tephra.operators import kernels

DF_GRID = (2, 3, 4, 5, 6, 8, 10)
ESTIMATORS, CRITERIA, FORMS = ("spline", "loess"), ("blocked-cv", "gcv"), ("linear", "loess")


def per_series(df: DataFrame, by: Sequence[str], fit: Callable[[pd.DataFrame], pd.DataFrame], columns: str, date: str = "date") -> DataFrame:
    """Rows of each series in order of date through `fit`, with NaN back as NULL."""
    kinds = dict(df.dtypes)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit(pdf.sort_values(date, kind="stable").reset_index(drop=True))
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out

    out = df.groupBy(*by).applyInPandas(f, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), columns]))
    return out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def linear_residual(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Residual of y on the columns of x with an intercept, over complete rows; y itself where they are too few."""
    ok = ~np.isnan(y) & ~np.isnan(x).any(axis=1)
    out = np.full(len(y), np.nan)
    out[ok] = kernels.residual_of(np.column_stack([np.ones(ok.sum()), x[ok]]), y[ok]) if ok.sum() >= x.shape[1] + 2 else y[ok]
    return out


def regress_out(df: DataFrame, value: str, covariates: Sequence[str], by: Sequence[str], form: str = "linear", name: str = "residual", date: str = "date") -> DataFrame:
    """Removes what the covariates explain. loess: a smooth of the leading covariate (wind_speed, else the first)."""
    if form not in FORMS:
        raise UnknownStrategyError("form", form, FORMS)
    if not covariates:
        raise ValueError("no covariates")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf[value].to_numpy(float), pdf[list(covariates)].to_numpy(float)
        if form == "linear":
            out = linear_residual(y, x)
        else:
            ok = ~np.isnan(y) & ~np.isnan(x).any(axis=1)
            driver = x[:, list(covariates).index("wind_speed") if "wind_speed" in covariates else 0]
            out = np.full(len(y), np.nan)
            out[ok] = y[ok] - kernels.lowess(driver[ok], y[ok], 0.6) if ok.sum() >= x.shape[1] + 2 else y[ok]
        return pd.DataFrame({date: pdf[date], value: y, name: out})

    return per_series(df, by, fit, f"`{date}` date, `{value}` double, `{name}` double", date)


def structural_residual(y: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Removes 0/1 terms that vary; rows with a gap and series too short for it stay as they are."""
    ok = ~np.isnan(y) & ~np.isnan(terms).any(axis=1)
    x = terms[ok]
    x = x[:, [len(np.unique(c)) > 1 for c in x.T]] if len(x) else x[:, :0]
    if not x.shape[1] or ok.sum() < x.shape[1] + 2:
        return y.copy()
    out = y.copy()
    out[ok] = kernels.residual_of(np.column_stack([np.ones(ok.sum()), x]), y[ok])
    return out


def choose_trend(y: np.ndarray, estimator: str = "spline", grid: Sequence[float] = DF_GRID, folds: int = 5, criterion: str = "blocked-cv", least: int = 24) -> tuple[np.ndarray, float, float]:
    """(trend, degrees of freedom, score) of a series' values without gaps, by order and not by date.

    Smoothness is chosen by the series' own prediction error alone; the first of equal scores wins.
    """
    n = len(y)
    if estimator not in ESTIMATORS:
        raise UnknownStrategyError("estimator", estimator, ESTIMATORS)
    if criterion not in CRITERIA:
        raise UnknownStrategyError("criterion", criterion, CRITERIA)
    if not len(grid) or criterion == "blocked-cv" and not 2 <= folds <= max(n, 2):
        raise TrendError("the grid is empty, or there are under 2 folds or more folds than points")
    if n < least:
        raise TrendError(f"{n} points, {least} are needed")
    if criterion == "gcv" and estimator != "spline":
        raise TrendError("gcv is defined for splines")
    most = n - n // folds if criterion == "blocked-cv" else n
    t = np.linspace(0, 1, n)
    usable = [d for d in grid if d <= most - 1] or [min(grid)]
    scores = [kernels.fold_error(t, y, d, estimator, folds) if criterion == "blocked-cv" else kernels.generalised_error(t, y, d) for d in usable]
    best = int(np.argmin(scores))
    return kernels.smooth(t, y, t, usable[best], estimator), float(usable[best]), float(scores[best])


def _on_known(y: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    out, ok = np.full(len(y), np.nan), ~np.isnan(y)
    out[ok] = f(y[ok])
    return out


TREND = "`date` date, signal double, trend_s_t double, residual_activity double, df double, cv_score double, status string"


def intensity_trend(df: DataFrame, value: str, by: Sequence[str], **how) -> DataFrame:
    """Trend and residual of each series; a series that can't be fitted has a status and no values, and stops no other."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[value].to_numpy(float)
        trend, dof, score, status = np.full(len(y), np.nan), np.nan, np.nan, "ok"
        try:
            known, dof, score = choose_trend(y[~np.isnan(y)], **how)
            trend[~np.isnan(y)] = known
        except TrendError as e:
            status = str(e)
        return pd.DataFrame({"date": pdf["date"], "signal": y, "trend_s_t": trend, "residual_activity": y - trend, "df": dof, "cv_score": score, "status": status})

    return per_series(df, by, fit, TREND)


def smoothness_residuals(df: DataFrame, value: str, by: Sequence[str], grid: Sequence[int] = DF_GRID, estimator: str = "spline") -> DataFrame:
    """Residuals at every fixed smoothness: one group for each series and degree, all in parallel."""
    wide = df.withColumn("df", F.explode(F.array(*[F.lit(float(d)) for d in grid])))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, dof = pdf[value].to_numpy(float), float(pdf["df"].iloc[0])
        n = int((~np.isnan(y)).sum())
        if dof > n - 1:
            return pd.DataFrame({"date": pdf["date"].iloc[:0], "residual": []})
        t = np.linspace(0, 1, n)
        return pd.DataFrame({"date": pdf["date"], "residual": _on_known(y, lambda v: v - kernels.smooth(t, v, t, dof, estimator))})

    return per_series(wide, [*by, "df"], fit, "`date` date, residual double")


def _decompose(y: np.ndarray, period: int) -> np.ndarray:
    """Residual of a robust seasonal-trend decomposition; gaps are bridged for the fit only."""
    ok = ~np.isnan(y)
    if not ok.any() or len(y) < 2 * period + 2:
        return np.full(len(y), np.nan)
    at = np.arange(len(y))
    season, trend = kernels.seasonal_trend(np.interp(at, at[ok], y[ok]), period)
    return np.where(ok, y - season - trend, np.nan)


def _calendar(dates: pd.Series) -> np.ndarray:
    """Days of any year; timestamps of nanoseconds end in 2262."""
    return dates.to_numpy().astype("datetime64[D]")


def _days(dates: pd.Series) -> np.ndarray:
    return _calendar(dates).astype(float)


def harmonic_residual(y: np.ndarray, dates: pd.Series, order: int = 1, least: int = 24) -> np.ndarray:
    """What trend and annual harmonics of the calendar leave."""
    base = _on_known(y, lambda v: v - choose_trend(v, least=least)[0])
    ok = ~np.isnan(base)
    if order == 0 or ok.sum() < 2 * order + 4:
        return base
    days = _calendar(dates)
    phase = 2 * np.pi * ((days - days.astype("datetime64[Y]")).astype(float) + 1) / 365.25  # from 1 January as day 1
    base[ok] = kernels.residual_of(kernels.harmonics(phase[ok], order), base[ok])
    return base


def additive_parts(y: np.ndarray, dates: pd.Series, growth: str = "linear", changepoint_prior: float = 0.05, yearly_order: int = 4, weekly_order: int = 3, min_valid_days: int = 120) -> dict[str, np.ndarray]:
    """Trend, yearly, weekly and residual on observed days, NaN on the others."""
    ok = ~np.isnan(y)
    if ok.sum() < min_valid_days:
        raise InsufficientDataError(f"{int(ok.sum())} days, {min_valid_days} are needed")
    days = _days(dates)[ok]
    model = kernels.AdditiveModel(days, y[ok], yearly_order, weekly_order, changepoint_prior, growth)
    out = {}
    for name, part in model.predict(days).items():
        out[name] = np.full(len(y), np.nan)
        out[name][ok] = part
    out["residual"] = y - out["trend"] - out["yearly"] - out["weekly"]
    return out


def additive_deseason(df: DataFrame, value: str, by: Sequence[str], **how) -> DataFrame:
    """(by, date, trend, yearly, weekly, residual) of each daily series."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"date": pdf["date"], **additive_parts(pdf[value].to_numpy(float), pdf["date"], **how)})

    return per_series(df, by, fit, "`date` date, trend double, yearly double, weekly double, residual double")


def additive_causal(df: DataFrame, value: str, by: Sequence[str], refit_every: int = 30, min_train: int = 730, min_valid_days: int = 120, **how) -> DataFrame:
    """Residuals of days from a model of the days before their block alone; NULL before the first model.

    Each block with its history is a group of its own, so that refits run in parallel.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, "date", value)
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("date")
    first = known.withColumn("__k", F.row_number().over(w)).groupBy(*by).agg(F.min(F.when(F.col("__k") == min_train + 1, F.col("date"))).alias("__first"), F.max("date").alias("__last"))
    anchors = first.where(F.col("__first").isNotNull()).select(*by, F.explode(F.sequence("__first", "__last", F.expr(f"interval {refit_every} days"))).alias("anchor"))
    blocks = known.join(anchors, list(by)).where(F.col("date") < F.date_add("anchor", refit_every))
    args = {"yearly": how.get("yearly_order", 4), "weekly": how.get("weekly_order", 3), "change_prior": how.get("changepoint_prior", 0.05), "growth": how.get("growth", "linear")}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        before = _calendar(pdf["date"]) < _calendar(pdf["anchor"])
        y, days = pdf[value].to_numpy(float), _days(pdf["date"])
        if before.all() or before.sum() < min_valid_days:
            return pd.DataFrame({"date": pdf["date"].iloc[:0], "residual_causal": []})
        model = kernels.AdditiveModel(days[before], y[before], **args)
        return pd.DataFrame({"date": pdf["date"][~before], "residual_causal": y[~before] - sum(model.predict(days[~before]).values())})

    scored = per_series(blocks, [*by, "anchor"], fit, "`date` date, residual_causal double").drop("anchor")
    return df.select(*by, "date").join(scored, [*by, "date"], "left")


#: Ways of removing the season: y, dates, rows of a year -> residual. yoy ways have a form without a fit in `index`.
DESEASON: dict[str, Callable[[np.ndarray, pd.Series, int], np.ndarray]] = {
    "stl": lambda y, dates, period: _decompose(y, period),
    "intensity-model": lambda y, dates, period: _on_known(y, lambda v: v - choose_trend(v)[0]),
    "harmonic": lambda y, dates, period: harmonic_residual(y, dates),
    "prophet": lambda y, dates, period: additive_parts(y, dates)["residual"],
}


def fitted_deseason(df: DataFrame, value: str, by: Sequence[str], method: str, period: int, name: str) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[value].to_numpy(float)
        try:
            out = DESEASON[method](y, pdf["date"], period)
        except (TrendError, InsufficientDataError):
            out = np.full(len(y), np.nan)
        return pd.DataFrame({"date": pdf["date"], value: y, name: out})

    return per_series(df, by, fit, f"`date` date, `{value}` double, `{name}` double")
