"""Causal events, their matching and their studies. Nothing here looks ahead of the row it scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.errors import InsufficientEventsError, MarketDataError, UnknownStrategyError
from tephra.functions.geo import ventilation
from tephra.operators import kernels
from tephra.operators.series import ordered

#: Fixed value: median absolute deviation to standard deviation of a normal distribution.
MAD_TO_SIGMA = 1.4826
SLACK = 0.5


def _past_median(value: str, by: Sequence[str], date: str, least: int, until: int) -> Column:
    w = ordered(by, date).rowsBetween(Window.unboundedPreceding, until)
    return F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w))


def causal_z(df: DataFrame, value: str, min_periods: int, by: Sequence[str] = (), date: str = "date", name: str = "z") -> DataFrame:
    """Robust z of each row against the rows before it.

    The centre is the median of all earlier values; the scale is the median of how far each earlier value lay from the
    centre that the row after it saw. Both need `min_periods` values, so the first z comes after twice as many rows.
    """
    stage = df.withColumn("__med", _past_median(value, by, date, min_periods, -1))
    stage = stage.withColumn("__dev", F.abs(F.lag(value).over(ordered(by, date)) - F.col("__med")))
    stage = stage.withColumn("__scale", MAD_TO_SIGMA * _past_median("__dev", by, date, min_periods, 0))
    return stage.withColumn(name, F.when(F.col("__scale") > 0, (F.col(value) - F.col("__med")) / F.col("__scale"))).drop("__med", "__dev", "__scale")


def cusum_flags(df: DataFrame, z: str, threshold: float, by: Sequence[str], date: str = "date", slack: float = SLACK) -> DataFrame:
    """(by, date, cusum): where a one-sided running sum of z beyond the slack passes the threshold; that side starts anew.

    The sums depend on the rows before through the resets, so each series is one array that is folded in order.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.coalesce(z, F.lit(0.0)).alias("z"))))

    def step(a, x):
        up, down = F.greatest(F.lit(0.0), a["up"] + x["z"] - slack), F.least(F.lit(0.0), a["down"] + x["z"] + slack)
        high = up > threshold
        low = ~high & (down < -threshold)
        out = F.concat(a["out"], F.array(F.struct(x["d"].alias("d"), (high | low).alias("f"))))
        return F.struct(F.when(high, 0.0).otherwise(up).alias("up"), F.when(low, 0.0).otherwise(down).alias("down"), out.alias("out"))

    kind = dict(df.dtypes)[date]
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast(f"array<struct<d:{kind},f:boolean>>").alias("out"))
    return df.groupBy(*by).agg(rows.alias("__s")).select(*by, F.explode(F.aggregate("__s", start, step, lambda a: a["out"])).alias("x")).select(*by, F.col("x.d").alias(date), F.col("x.f").alias("cusum"))


DETECTORS = ("zscore", "cusum", "both")


def detect(df: DataFrame, value: str = "residual", by: Sequence[str] = (), *, method: str = "zscore", z_thresh: float = 2.0, min_periods: int = 12, coverage: str | None = None, min_coverage: float = 0.25, vent: str | None = None, ventilation_z: float = 1.5, date: str = "date") -> DataFrame:
    """Events (by, date, direction, z, magnitude, detector) of each series.

    coverage: column under which a known low coverage is no event. vent: column of a ventilation index; a surge in
    stagnant air or a drop in strong ventilation is weather.
    """
    if method not in DETECTORS:
        raise UnknownStrategyError("detector", method, DETECTORS)
    scored = causal_z(df, value, min_periods, by, date)
    beyond = F.coalesce(F.abs("z") >= z_thresh, F.lit(False))
    if method == "zscore":
        scored = scored.withColumn("__fired", beyond).withColumn("detector", F.lit("zscore"))
    else:
        scored = scored.join(cusum_flags(scored, "z", z_thresh, by, date), [*by, date])
        if method == "cusum":
            scored = scored.withColumn("__fired", F.col("cusum")).withColumn("detector", F.lit("cusum"))
        else:
            name = F.when(beyond & F.col("cusum"), "both").when(beyond, "zscore").otherwise("cusum")
            scored = scored.withColumn("__fired", beyond | F.col("cusum")).withColumn("detector", name)
    keep = F.col("__fired") & F.col(value).isNotNull()
    if coverage:
        keep &= F.col(coverage).isNull() | (F.col(coverage) >= min_coverage)
    direction = F.when(F.coalesce(F.col("z") >= 0, F.lit(False)), "surge").otherwise("drop")
    if vent:
        scored = causal_z(scored, vent, min_periods, by, date, "__vz")
        weather = ((direction == "surge") & (F.col("__vz") <= -ventilation_z)) | ((direction == "drop") & (F.col("__vz") >= ventilation_z))
        keep &= ~F.coalesce(weather, F.lit(False))
    return scored.where(keep).select(*by, date, direction.alias("direction"), "z", F.col(value).alias("magnitude"), "detector")


def jump_events(df: DataFrame, value: str = "value", by: Sequence[str] = (), z_thresh: float = 1.5, min_periods: int = 12, date: str = "date", cause: str = "bf_rate") -> DataFrame:
    """Large changes between consecutive rows, scored like events; a NULL row breaks the change after it."""
    changes = df.withColumn("__c", F.col(value) - F.lag(value).over(ordered(by, date)))
    scored = causal_z(changes, "__c", min_periods, by, date)
    return scored.where(F.abs("z") >= z_thresh).select(*by, date, F.when(F.col("z") >= 0, "up").otherwise("down").alias("direction"), "z", F.lit(cause).alias("cause"))


def interval_edges(calendar: DataFrame) -> DataFrame:
    """An event at the start of each interval and one of the other direction at its end."""
    begin = F.struct(F.col("start").alias("date"), F.col("direction"), F.col("cause"))
    back = F.when(F.col("direction") == "down", "up").otherwise("down")
    finish = F.struct(F.col("end").alias("date"), back.alias("direction"), F.concat("cause", F.lit("_end")).alias("cause"))
    return calendar.select(F.explode(F.array(begin, finish)).alias("e")).select("e.date", "e.direction", F.lit(None).cast("double").alias("z"), "e.cause")


def production_events(jumps: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Jumps and interval edges together; of one date and direction, jumps come first, then causes in order."""
    every = jumps.select("date", "direction", "z", "cause", F.lit(0).alias("__o"))
    if calendar is not None:
        every = every.unionByName(interval_edges(calendar).withColumn("__o", F.lit(1)))
    w = Window.partitionBy("date", "direction").orderBy("__o", "cause")
    return every.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__o")


#: Which change of production an event stands for.
EXPECTED = {"surge": "up", "drop": "down"}


def match(events: DataFrame, production: DataFrame, window_days: int = 14, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (by, no2_date, prod_date, direction, lead_days, cause): each event takes the nearest free change in its window.

    Events go in order of date, then direction, and a change is taken once, so each key is one fold over its events.
    Only changes in the window of an event are gathered for it, by a join on coarse windows of time.
    """
    wide = max(window_days, 1)
    slot = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / wide)
    want = F.when(F.col("direction") == "surge", "up").when(F.col("direction") == "drop", "down")
    own = events.select(*by, F.col("date").alias("e"), "direction", want.alias("__want"), F.explode(F.array(slot("date") - 1, slot("date"), slot("date") + 1)).alias("__slot"))
    other = production.select(*by, F.col("date").alias("p"), F.col("direction").alias("__want"), "cause", slot("date").alias("__slot"))
    near = own.join(other, [*by, "__want", "__slot"]).where(F.abs(F.datediff("p", "e")) <= window_days)
    candidate = F.struct(F.abs(F.datediff("p", "e")).alias("gap"), F.col("p"), F.col("cause"))
    options = near.groupBy(*by, "e", "direction", "__want").agg(F.array_sort(F.collect_list(candidate)).alias("options"))
    queue = options.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("e", "direction", "__want", "options"))).alias("q"))

    def step(taken, x):
        used = lambda o: F.exists(taken, lambda t: (t["p"] == o["p"]) & (t["w"] == x["__want"]))
        best = F.try_element_at(F.filter(x["options"], lambda o: ~used(o)), F.lit(1))
        pair = F.struct(x["e"].alias("e"), best["p"].alias("p"), x["direction"].alias("d"), x["__want"].alias("w"), best["cause"].alias("c"))
        return F.when(best.isNull(), taken).otherwise(F.concat(taken, F.array(pair)))

    kind = "array<struct<e:date,p:date,d:string,w:string,c:string>>"
    folded = queue.select(*by, F.explode(F.aggregate("q", F.array().cast(kind), step)).alias("m"))
    return folded.select(*by, F.col("m.e").alias("no2_date"), F.col("m.p").alias("prod_date"), F.col("m.d").alias("direction"), F.datediff("m.p", "m.e").cast("double").alias("lead_days"), F.col("m.c").alias("cause"))


def match_summary(events: DataFrame, production: DataFrame, matched: DataFrame) -> DataFrame:
    """Precision, recall, false discovery and lead of a matching; ratios over nothing are NULL."""
    n = events.agg(F.count("*").alias("n_no2")).crossJoin(production.agg(F.count("*").alias("n_prod")))  # one row each
    m = matched.agg(F.count("*").alias("n_matched"), F.percentile("lead_days", F.lit(0.5)).alias("median_lead_days"), F.avg((F.col("lead_days") > 0).cast("double")).alias("lead_positive_frac"))
    precision = F.col("n_matched") / F.nullif(F.col("n_no2"), F.lit(0))
    return n.crossJoin(m).select("n_no2", "n_prod", "n_matched", precision.alias("precision"), (F.col("n_matched") / F.nullif(F.col("n_prod"), F.lit(0))).alias("recall"), (1 - precision).alias("false_discovery_rate"), "median_lead_days", "lead_positive_frac")


def conclusion(summary: DataFrame) -> DataFrame:
    weak = (F.col("n_matched") == 0) | ~F.coalesce(F.col("recall") > 0, F.lit(False)) | ~F.coalesce(F.col("precision") >= 0.3, F.lit(False))
    leads = (F.col("median_lead_days") > 1) & (F.col("lead_positive_frac") >= 0.5)
    return summary.withColumn("conclusion", F.when(weak, "null").when(leads, "lead").otherwise("coincident"))


def confirm(events: DataFrame, matched: DataFrame) -> DataFrame:
    """Marks events whose date was matched."""
    dates = matched.select(F.col("no2_date").alias("date"), F.lit(True).alias("confirmed")).distinct()
    return events.join(dates, "date", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def enough_events(events: DataFrame, least: int) -> DataFrame:
    found = events.limit(least).count()
    if found < least:
        raise InsufficientEventsError(f"{found} events, {least} are needed")
    return events


# ---------------------------------------------------------------- markets


def abnormal_returns(prices: DataFrame, benchmark: str, instruments: Sequence[str] | None = None) -> DataFrame:
    """(symbol, date, ret, abnormal_return): simple return less that of the benchmark on the same date.

    Returns are taken on the dates that any symbol has; across a date without a close there is none. Dates are numbered
    in one task, of which there are as many as days of trading.
    """
    if prices.where((F.col("symbol") == benchmark) & F.col("close").isNotNull()).isEmpty():
        raise MarketDataError(f"no prices of the benchmark {benchmark}")
    sessions = prices.select("date").distinct().withColumn("__k", F.row_number().over(Window.orderBy("date")))
    numbered = prices.join(sessions, "date")
    w = Window.partitionBy("symbol").orderBy("__k")
    back = F.when(F.lag("__k").over(w) == F.col("__k") - 1, F.lag("close").over(w))
    returns = numbered.withColumn("ret", F.col("close") / F.nullif(back, F.lit(0.0)) - 1).select("symbol", "date", "ret")
    market = returns.where(F.col("symbol") == benchmark).select("date", F.col("ret").alias("__m"))
    own = returns.where(F.col("symbol") != benchmark)
    if instruments is not None:
        own = own.where(F.col("symbol").isin(*instruments))
    return own.join(market, "date").withColumn("abnormal_return", F.col("ret") - F.col("__m")).where(F.col("abnormal_return").isNotNull()).drop("__m")


#: Instruments up to which their list is broadcast.
MOST_SYMBOLS = 100_000


def forward_car(events: DataFrame, returns: DataFrame, window: int = 5, latency_days: int = 2, expected: Mapping[str, int] | None = None) -> DataFrame:
    """Sum of the first `window` abnormal returns from an event's date plus the latency on, for each instrument.

    Sums are made once for each session by a window over its symbol, and each event looks up the first session that
    is not before it: an as-of join by union and one ordered window, without pairing events and sessions.
    """
    expected = expected or {"surge": 1, "drop": -1}
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(0, window - 1)
    sums = returns.select("symbol", "date", F.sum("abnormal_return").over(w).alias("car"))
    trades = events.select(F.col("date").alias("event_date"), "direction", F.date_add("date", latency_days).alias("trade_date"))
    symbols = returns.select("symbol").distinct()
    few = symbols.limit(MOST_SYMBOLS + 1).count() <= MOST_SYMBOLS
    trades = trades.crossJoin(F.broadcast(symbols) if few else symbols)  # every event is studied on every instrument
    both = sums.select("symbol", F.col("date").alias("__d"), F.lit(1).alias("__side"), F.lit(None).cast("date").alias("event_date"), F.lit(None).cast("string").alias("direction"), "car")
    both = both.unionByName(trades.select("symbol", F.col("trade_date").alias("__d"), F.lit(0).alias("__side"), "event_date", "direction", F.lit(None).cast("double").alias("car")))
    # from the last date down, so that the frame only grows
    down = Window.partitionBy("symbol").orderBy(F.desc("__d"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("car", F.last("car", ignorenulls=True).over(down)).where(F.col("__side") == 0)
    sign = F.coalesce(*[F.when(F.col("direction") == d, F.lit(s)) for d, s in expected.items()])
    return found.select(F.col("symbol").alias("instrument"), "event_date", "direction", "car", F.when(F.col("car").isNotNull() & sign.isNotNull(), F.signum("car") == sign).alias("hit"))


def study(per_event: DataFrame) -> DataFrame:
    """Number, mean and hit rate by instrument."""
    return per_event.groupBy("instrument").agg(F.count("car").alias("n_events"), F.avg("car").alias("car_mean"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def mean_intervals(df: DataFrame, value: str, by: Sequence[str], draws: int = 2000, seed: int = 12345) -> DataFrame:
    """Bootstrap interval of each key's mean, over values in the order of the keys' rows by value."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = kernels.mean_interval(pdf[value].sort_values(kind="stable").to_numpy(float), draws, seed)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, "ci_low": low, "ci_high": high}])

    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in by), "ci_low double", "ci_high double"])
    out = df.select(*by, value).groupBy(*by).applyInPandas(f, schema)
    return out.select(*by, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("ci_low", "ci_high")])


def market_verdict(study_rows: DataFrame) -> DataFrame:
    """market_signal if some instrument's interval lies on one side of 0."""
    apart = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return study_rows.agg(F.when(F.max(apart), "market_signal").otherwise("market_null").alias("verdict"))


def with_ventilation(meteo: DataFrame) -> DataFrame:
    """Adds vent: wind speed (or that of u10 and v10) times the height of the boundary layer, 1 where there is none."""
    if "wind_speed" in meteo.columns:
        wind = F.col("wind_speed")
    elif {"u10", "v10"} <= set(meteo.columns):
        wind = F.hypot("u10", "v10")
    else:
        raise ValueError("wind_speed, or u10 and v10, are needed")
    return meteo.withColumn("vent", ventilation(wind, F.col("blh")) if "blh" in meteo.columns else wind)
