"""Whole analyses as functions of frames; nothing is written between their steps unless a caller does."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.config import ACTIVE_STATUS, ENVELOPE
from tephra.errors import IncompleteCubeError, InsufficientOverlapError
from tephra.functions import statistics as st
from tephra.functions.calendar import PERIODS
from tephra.functions.cleaning import PREDICTORS, TARGETS, coverage_screen, pick_column
from tephra.operators import correlate as co
from tephra.operators import events as ev
from tephra.operators import grid as g
from tephra.operators import index as ix
from tephra.operators import series as se
from tephra.operators import sweep as sw
from tephra.operators import trend as tr
from tephra.sources.scratch import stored

ONE = ["series_id"]

#: How a variant of a sweep is deseasonalised.
VARIANTS = {"level": "none", "yoy": "yoy", "intensity": "intensity-model", "harmonic": "harmonic", "stl": "stl", "yoy-double-diff": "yoy-double-diff"}


# Months of the heating season.
HEATING_MONTHS = (11, 12, 1, 2, 3)


def build_cube(observations: DataFrame, freq: str = "W", **screens) -> tuple[DataFrame, DataFrame]:
    """The composite cube and its mean series; grids of different shapes are refused. screens: those of `composite`."""
    g.uniform_shape(observations)
    cube = g.composite(observations, freq, **screens)
    return cube, g.aoi_mean(cube)


def assert_complete(cube: DataFrame, first: str, last: str, freq: str = "W", least: float = 0.9, require: bool = True) -> float:
    fraction = se.completeness(cube, first, last, freq, "period").first()["fraction"]
    if require and fraction < least:
        raise IncompleteCubeError(f"{fraction:.0%} of the expected periods are there, {least:.0%} are needed")
    return fraction


# Radius of the footprint and of the ring around it, in km.
RADII = (15.0, 25.0, 60.0)


def footprint(cube: DataFrame, facilities: DataFrame, radii: tuple[float, float, float] = RADII, mode: str = "subtract", status: Sequence[str] = ACTIVE_STATUS) -> DataFrame:
    """Footprint signal around the active facilities; degenerate masks are refused."""
    return g.footprint_signal(cube, *g.checked_masks(g.cells(cube), g.active(facilities, status), *radii), mode=mode)


def meteo_series(meteo: DataFrame, footprint_cells: DataFrame, values: Sequence[str], freq: str = "W") -> DataFrame:
    """Covariates over the footprint: hours of the overpass, nearest cells, means by time and period, speed of mean wind."""
    hours = g.overpass_hours(meteo)
    mapped = g.regrid_nearest(hours, footprint_cells, values)
    daily = mapped.groupBy(F.to_date("time").alias("date"), "time").agg(*[F.avg(v).alias(v) for v in values])
    out = se.resample(daily, freq, list(values))
    return out.withColumn("wind_speed", F.hypot("u10", "v10")) if {"u10", "v10"} <= set(values) else out


def activity_index(signal: DataFrame, meteo: DataFrame | None = None, calendar: DataFrame | None = None, freq: str = "W", *, form: str = "linear", deseason: str = "yoy", anchor: str = "zscore", heating_months: tuple[int, ...] = HEATING_MONTHS) -> DataFrame:
    """(series_id, date, index_value, valid_coverage) from a footprint signal with no2_corrected and valid_coverage."""
    s = signal.withColumn("series_id", F.lit("signal")).select("series_id", "date", F.col("no2_corrected").alias("value"), "valid_coverage")
    cover = s.select("date", "valid_coverage")
    value = "value"
    if meteo is not None:
        names = [c for c in meteo.columns if c not in ("date", "series_id")]
        joined = s.join(meteo.select("date", *names), "date", "left")
        s, value = tr.regress_out(joined, "value", names, ONE, form), "residual"
    s = ix.deseasonalise(s.select("series_id", "date", F.col(value).alias("value")), "value", ONE, deseason, PERIODS[freq], "flat").select("series_id", "date", "flat")
    if calendar is None:
        s = ix.without_heating(s, "flat", heating_months, ONE)
    else:
        from tephra.functions.calendar import heating_season

        s = ix.in_interval(s.withColumn("heating", heating_season(F.col("date"), heating_months)), calendar)
        s = ix.without_terms(s, "flat", ["heating", "curtailment"], ONE)
    out = ix.build_index(s, "flat", ONE, anchor).join(cover, "date", "left")
    return out.select("series_id", "date", "index_value", "valid_coverage")


# Bounds of the share of the column that a source region can have.
ATTRIBUTABLE_CAP = (0.30, 0.43)


def provenance(deseason: str, anchor: str, form: str | None = None, covariates: Sequence[str] = ()) -> dict:
    """What an index was made with, beside it. form: how covariates were removed, if they were."""
    notes = {"anchor": anchor, "attributable_cap": list(ATTRIBUTABLE_CAP), "deseason_method": deseason, "structural_terms": ["heating_season"], "harmonic_order": 1 if deseason == "harmonic" else None}
    return notes | ({"meteo_form": form, "meteo_covariates": list(covariates)} if form else {})


def aligned(index: DataFrame, target: DataFrame, freq: str = "W", min_coverage: float = 0.25) -> DataFrame:
    """(date, index, benchmark) on periods that both have, after the coverage screen."""
    x, y = pick_column(index, PREDICTORS, "predictor"), pick_column(target, TARGETS, "target")
    value = coverage_screen(F.col(x), F.col("valid_coverage"), min_coverage) if "valid_coverage" in index.columns else F.col(x)
    left = se.resample(index.select("date", value.alias("index")), freq, ["index"])
    right = se.resample(target.select("date", F.col(y).alias("benchmark")), freq, ["benchmark"])
    return se.align(left, right)


# Correlations from which a finding counts as weak and as strong.
BAR = (0.50, 0.75)


def validate(index: DataFrame, target: DataFrame, freq: str = "W", *, min_coverage: float = 0.25, max_lag: int = 8, min_overlap: int = 26, bar: tuple[float, float] = BAR, alpha: float = 0.05) -> dict:
    """Payload of a validation: correlation, sign, lead-lag, conclusion. A null result is a result."""
    how = {"freq": freq, "min_coverage": min_coverage, "max_lag": max_lag, "min_overlap": min_overlap, "bar": bar, "alpha": alpha}
    both = aligned(index, target, freq, min_coverage).withColumn("series_id", F.lit("signal")).persist()
    try:
        n = both.count()
        if n < min_overlap:
            raise InsufficientOverlapError(f"{n} periods overlap, {min_overlap} are needed")
        r = co.correlate(both, "index", "benchmark", ONE)
        table = co.ccf(both, "index", "benchmark", max_lag, ONE)
        significant = F.col("p") < alpha
        row = r.join(co.peak(table, ONE), ONE).select("r", "n", "p", "ci_low", "ci_high", "peak_lag", "peak_r", "band", significant.alias("significant"), st.sign_label(F.col("r"), significant).alias("sign"), st.bar_class(F.col("peak_r"), bar).alias("bar"), st.lead_conclusion(significant, F.col("peak_r"), F.col("peak_lag"), bar).alias("conclusion")).first().asDict()
        lags = [x.asDict() for x in table.select("lag", "r", "n").orderBy("lag").collect()]  # 2 * max_lag + 1 rows
        return row | {"ccf": lags, "config": how}
    finally:
        both.unpersist()


def validation_summary(payload: Mapping) -> str:
    interval = f"[{payload['ci_low']:.3f}, {payload['ci_high']:.3f}]" if payload["ci_low"] is not None else "not defined"
    return "\n".join([
        "Activity index against the physical series",
        f"  correlation  {payload['r']:.4f} over {payload['n']} periods, p = {payload['p']:.3g}, interval {interval}",
        f"  sign         {payload['sign']}",
        f"  lead-lag     peak {payload['peak_r']:.4f} at lag {payload['peak_lag']} (positive: the index leads), band {payload['band']:.3f}",
        f"  bar          {payload['bar']}",
        f"  conclusion   {payload['conclusion']}",
        "",
    ])


# Symbols of the market study.
INSTRUMENTS, BENCHMARK = ("BHP", "RIO", "VALE", "SLX"), "ACWI"


def catalyst(residual: DataFrame, target: DataFrame, meteo: DataFrame | None = None, calendar: DataFrame | None = None, prices: DataFrame | None = None, freq: str = "W", *, detector: str = "zscore", z_thresh: float = 2.0, min_periods: int = 12, min_coverage: float = 0.25, ventilation_z: float = 1.5, jump_z: float = 1.5, match_window: int = 2, study_window: int = 5, latency_days: int = 2, min_events: int = 5, instruments: Sequence[str] = INSTRUMENTS, benchmark: str = BENCHMARK) -> dict[str, DataFrame]:
    """Events, their matching with production, and the market study where there are prices.

    residual: (series_id, date, residual_activity and perhaps valid_coverage); target: (series_id, date, value).
    match_window: in periods.
    """
    vent = None
    if meteo is not None:
        residual = residual.join(ev.with_ventilation(meteo).select("date", "vent"), "date", "left")
        vent = "vent"
    found = ev.detect(residual, "residual_activity", ONE, method=detector, z_thresh=z_thresh, min_periods=min_periods, coverage="valid_coverage" if "valid_coverage" in residual.columns else None, min_coverage=min_coverage, vent=vent, ventilation_z=ventilation_z)
    ev.enough_events(found, min_events)
    production = ev.production_events(ev.jump_events(target, "value", ONE, jump_z, min_periods), calendar)
    matched = ev.match(found, production, match_window * (7 if freq == "W" else 30))
    out = {"events": ev.confirm(found, matched), "production": production, "matched": matched, "summary": ev.conclusion(ev.match_summary(found, production, matched))}
    if prices is not None:
        confirmed = out["events"].where("confirmed")
        used = confirmed if confirmed.limit(min_events).count() >= min_events else out["events"]
        out["per_event"] = ev.forward_car(used, ev.abnormal_returns(prices, benchmark, instruments), study_window, latency_days)
        intervals = ev.mean_intervals(out["per_event"].where("car IS NOT NULL"), "car", ["instrument"])
        out["study"] = ev.study(out["per_event"]).join(intervals, "instrument", "left")
        out["verdict"] = ev.market_verdict(out["study"])
    return out


def scale_signal(cube: DataFrame, facilities: DataFrame, buffer: float, fx: int = 1, fy: int = 1, least_cells: int = 4, radii: tuple[float, float, float] = RADII, mode: str = "subtract") -> DataFrame:
    """(date, value, label, n_cells) of a clip of the cube in blocks of fx by fy cells.

    With too few cells for a footprint, or without a ring, the mean of the whole clip stands in and says so.
    """
    part = g.checked_clip(cube, ENVELOPE.buffered(buffer))
    if fx > 1 or fy > 1:
        low = part.agg(F.min("ix").alias("x0"), F.min("iy").alias("y0"))
        part = part.crossJoin(F.broadcast(low)).withColumn("ix", F.col("ix") - F.col("x0")).withColumn("iy", F.col("iy") - F.col("y0")).drop("x0", "y0")  # one row
        part = g.coarsen(part, fx, fy)
    cells = g.cells(part)
    fp = g.radius_mask(cells, facilities, radii[0])
    ring = g.ring_mask(cells, fp, facilities, *radii[1:])
    n_cells, n_ring = fp.count(), ring.limit(1).count()  # sizes of masks, not of the cube
    if n_cells >= least_cells and n_ring:
        return g.footprint_signal(part, fp, ring, mode).select("date", F.col("no2_corrected").alias("value"), F.lit("footprint").alias("label"), F.lit(n_cells).alias("n_cells"))
    return part.groupBy(F.col("period").alias("date")).agg(F.avg("value").alias("value")).select("date", "value", F.lit("aoi-mean-fallback").alias("label"), F.lit(cells.count()).alias("n_cells"))


def variants(signals: DataFrame, by: Sequence[str], freqs: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, freq, variant, date, v): each series at each frequency under each way of removing the season."""
    out = []
    for freq in freqs:
        level = se.resample(signals, freq, ["value"], by)
        for name in names:
            made = ix.deseasonalise(level, "value", by, VARIANTS[name], PERIODS[freq], "v")
            out.append(made.select(*by, F.lit(freq).alias("freq"), F.lit(name).alias("variant"), "date", "v"))
    return reduce(DataFrame.unionByName, out)


def sweep_correlations(signals: DataFrame, target: DataFrame, by: Sequence[str], freqs: Sequence[str], names: Sequence[str], **how) -> DataFrame:
    """Robust correlations of all variants with a target (date, value).

    how: lags, overlap, draws and seed, as `robust_correlations` takes them.
    """
    made = variants(signals, by, freqs, names)
    parts = [se.resample(target, f, ["value"]).select(F.lit(f).alias("freq"), "date", F.col("value").alias("y")) for f in freqs]
    joined = made.join(reduce(DataFrame.unionByName, parts), ["freq", "date"]).where("v IS NOT NULL AND y IS NOT NULL")
    return sw.robust_correlations(joined, "v", "y", [*by, "freq", "variant"], **how)


def sweep_rows(signals: DataFrame, target: DataFrame, by: Sequence[str], freqs: Sequence[str], names: Sequence[str], *, alpha: float = 0.05, **how) -> DataFrame:
    """`sweep_correlations`, adjusted within lag kinds, with verdicts."""
    return sw.verdicts(sweep_correlations(signals, target, by, freqs, names, **how), alpha, [*by, "freq", "variant"])


# The grid of a sweep.
BUFFERS, RESOLUTIONS, SWEPT, FREQUENCIES = (0.25, 0.10), ("native", 0.10, 0.15, 0.25), ("level", "yoy", "intensity", "harmonic"), ("W", "ME")


def scale_sweep(cube: DataFrame, target: DataFrame, facilities: DataFrame, buffers: Sequence[float] = BUFFERS, resolutions: Sequence[float | str] = RESOLUTIONS, names: Sequence[str] = SWEPT, freqs: Sequence[str] = FREQUENCIES, least_cells: int = 4, *, alpha: float = 0.05, **how) -> DataFrame:
    """Extent x resolution x frequency x variant x lag as one frame; resampling runs in parallel over its keys.

    Resolutions that come to the same blocks of cells have the same signal and, as the seed is fixed, the same draws:
    both are made once, and each resolution gets its rows before p values are adjusted.
    """
    native = [g.spacing(cube, a, i).first()[0] for a, i in (("lon", "ix"), ("lat", "iy"))]
    blocks: dict[tuple[int, int], list[str]] = {}
    for res in dict.fromkeys(resolutions):
        fx, fy = (1, 1) if res == "native" else [round(float(res) / s) for s in native]
        if min(fx, fy) >= 1:  # else finer than the grid
            blocks.setdefault((fx, fy), []).append(str(res))
    signals = [
        scale_signal(cube, facilities, buffer, fx, fy, least_cells).select(F.lit(float(buffer)).alias("buffer"), F.lit(",".join(same)).alias("resolution"), "label", "date", "value")
        for buffer in buffers
        for (fx, fy), same in blocks.items()
    ]
    # rows a period each; every variant reads them
    by = ["buffer", "resolution", "label"]
    rows = sweep_correlations(stored(reduce(DataFrame.unionByName, signals), "signals"), stored(target, "target"), by, freqs, names, **how)
    rows = rows.withColumn("resolution", F.explode(F.split("resolution", ",")))
    return sw.verdicts(rows, alpha, [*by, "freq", "variant"])


def robust_changes(rows: DataFrame) -> DataFrame:
    """Findings of a sweep: where a coarser grid changes the sign of a correlation, and outcomes by resolution."""
    native = rows.where(F.col("resolution") == "native").select("buffer", "freq", "variant", "lag_kind", F.signum("r").alias("__s"))
    both = rows.join(native, ["buffer", "freq", "variant", "lag_kind"], "left")
    return both.groupBy("resolution").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "robust").alias("robust"), F.count_if(F.col("verdict").startswith("fragile")).alias("naive_only"), F.count_if(F.signum("r") != F.col("__s")).alias("sign_changes"))
