"""Queries of events, matching and market studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.operators import events as e
from tephra.plans import frames as fr
from tephra.plans.frames import SERIES, rounded
from tephra.registry import query

_SG = f"{fr.SIGNAL_DAYS}, {fr.regular('sg', 'sd', {'value': 'avg(value)'})}"


def _z(source: str, value: str, m: int, name: str) -> str:
    """CTE of a causal z over (date, value) rows."""
    return f"""{name}_m AS (SELECT *, CASE WHEN count({value}) OVER p >= {m} THEN quantile_cont({value}, 0.5) OVER p END AS med, lag({value}) OVER (ORDER BY date) AS before FROM {source} WINDOW p AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_d AS (SELECT *, abs(before - med) AS dev FROM {name}_m),
{name}_s AS (SELECT *, 1.4826 * CASE WHEN count(dev) OVER q >= {m} THEN quantile_cont(dev, 0.5) OVER q END AS scale FROM {name}_d WINDOW q AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (SELECT * EXCLUDE (med, before, dev, scale), CASE WHEN scale > 0 THEN ({value} - med) / scale END AS z FROM {name}_s)"""


_ZS = f"{_SG}, {_z('sg', 'value', 12, 'zs')}"


@query("W1, W2", f"WITH {_ZS} SELECT date, round(z, 6) AS z FROM zs")
def causal_z(spark, d):
    return rounded(e.causal_z(fr.signal(spark, d), "value", 12, SERIES).select("date", "z"))


#: Running sums with resets, one row after the other.
_CUSUM = """o AS (SELECT date, coalesce(z, 0) AS z, row_number() OVER (ORDER BY date) AS n FROM zs),
cu AS (SELECT n, date, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS f FROM (SELECT 0::BIGINT AS n, NULL::DATE AS date) UNION ALL
SELECT o.n, o.date, CASE WHEN u > 2 THEN 0 ELSE u END, CASE WHEN NOT u > 2 AND w < -2 THEN 0 ELSE w END, u > 2 OR w < -2 FROM (SELECT o.n, o.date, greatest(0, cu.up + o.z - 0.5) AS u, least(0, cu.down + o.z + 0.5) AS w FROM cu JOIN o ON o.n = cu.n + 1) o)"""


@query("W5", f"WITH RECURSIVE {_ZS}, {_CUSUM} SELECT date, f AS cusum FROM cu WHERE n > 0")
def cusum(spark, d):
    return e.cusum_flags(e.causal_z(fr.signal(spark, d), "value", 12, SERIES), "z", 2.0, SERIES).select("date", "cusum")


_DETECTED = f"{_ZS}, ev AS (SELECT date, CASE WHEN z >= 0 THEN 'surge' ELSE 'drop' END AS direction, z, value AS magnitude FROM zs WHERE abs(z) >= 1.0 AND value IS NOT NULL)"


@query("M25", f"WITH {_DETECTED} SELECT date, direction, round(z, 6) AS z, round(magnitude, 6) AS magnitude, 'zscore' AS detector FROM ev")
def detect_zscore(spark, d):
    return rounded(e.detect(fr.signal(spark, d), "value", SERIES, z_thresh=1.0).drop("series_id"))


_VENT = f"{fr.weather_sql()}, sv AS (SELECT date, sg.value, sqrt(u10 * u10 + v10 * v10) * blh AS vent, blh / 30 AS cov FROM sg LEFT JOIN we USING (date)), {_z('sv', 'vent', 12, 'zv')}"


@query("M24, M25, F8", f"""WITH RECURSIVE {_ZS}, {_CUSUM}, {_VENT} SELECT zs.date, CASE WHEN coalesce(zs.z >= 0, false) THEN 'surge' ELSE 'drop' END AS direction, round(zs.z, 6) AS z, round(zs.value, 6) AS magnitude,
CASE WHEN coalesce(abs(zs.z) >= 2, false) AND f THEN 'both' WHEN coalesce(abs(zs.z) >= 2, false) THEN 'zscore' ELSE 'cusum' END AS detector
FROM zs JOIN cu USING (date) JOIN zv USING (date) WHERE (coalesce(abs(zs.z) >= 2, false) OR f) AND zs.value IS NOT NULL AND (cov IS NULL OR cov >= 0.84)
AND NOT coalesce((coalesce(zs.z >= 0, false) AND zv.z <= -0.5) OR (NOT coalesce(zs.z >= 0, false) AND zv.z >= 0.5), false)""")  # fmt: skip
def detect_screened(spark, d):
    s = fr.signal(spark, d).join(e.with_ventilation(fr.weather(spark, d)), ["series_id", "date"], "left").withColumn("cov", F.col("blh") / 30)
    return rounded(e.detect(s, "value", SERIES, method="both", coverage="cov", min_coverage=0.84, vent="vent", ventilation_z=0.5).drop("series_id"))


_JUMPS = f"{fr.TARGET_DAYS}, {fr.regular('tg', 'td', {'value': 'avg(value)'})}, ch AS (SELECT date, value - lag(value) OVER (ORDER BY date) AS c FROM tg), {_z('ch', 'c', 12, 'zj')}, jp AS (SELECT date, CASE WHEN z >= 0 THEN 'up' ELSE 'down' END AS direction, z, 'bf_rate' AS cause FROM zj WHERE abs(z) >= 1.5)"


@query("M26, T8", f"WITH {_JUMPS} SELECT date, direction, round(z, 6) AS z, cause FROM jp")
def jump_events(spark, d):
    return rounded(e.jump_events(fr.target(spark, d), "value", SERIES).drop("series_id"))


_CALENDAR = "cl AS (SELECT * FROM (VALUES (date '1996-02-04', date '1996-03-03', 'down', 'curtailment'), (date '1997-08-10', date '1997-09-07', 'up', 'restart'), (date '1999-01-03', date '1999-01-31', 'down', 'curtailment')) v(start, stop, direction, cause)), ce AS (SELECT start AS date, direction, cause FROM cl UNION ALL SELECT stop, CASE WHEN direction = 'down' THEN 'up' ELSE 'down' END, cause || '_end' FROM cl)"


def _calendar(spark):
    return spark.sql("select * from values (date '1996-02-04', date '1996-03-03', 'down', 'curtailment'), (date '1997-08-10', date '1997-09-07', 'up', 'restart'), (date '1999-01-03', date '1999-01-31', 'down', 'curtailment') v(`start`, `end`, direction, cause)")


@query("O5", f"WITH {_CALENDAR} SELECT date, direction, NULL::DOUBLE AS z, cause FROM ce")
def interval_edges(spark, d):
    return e.interval_edges(_calendar(spark))


_PRODUCTION = f"{_JUMPS}, {_CALENDAR}, al AS (SELECT date, direction, z, cause, 0 AS o FROM jp UNION ALL SELECT date, direction, NULL, cause, 1 FROM ce), po AS (SELECT date, direction, z, cause FROM al QUALIFY row_number() OVER (PARTITION BY date, direction ORDER BY o, cause) = 1)"


@query("O4, O6, T11", f"WITH {_PRODUCTION} SELECT date, direction, round(z, 6) AS z, cause FROM po")
def production_events(spark, d):
    return rounded(e.production_events(e.jump_events(fr.target(spark, d), "value", SERIES), _calendar(spark)))


def _matched(spark, d):
    found = e.detect(fr.signal(spark, d), "value", SERIES, z_thresh=1.0)
    production = e.production_events(e.jump_events(fr.target(spark, d), "value", SERIES), _calendar(spark))
    return found, production, e.match(found, production, 21)


#: Greedy nearest matching, one event after the other, with the dates taken so far in a list.
_MATCH = f"""{_DETECTED}, {_PRODUCTION}, en AS (SELECT *, row_number() OVER (ORDER BY date, direction) AS n, CASE WHEN direction = 'surge' THEN 'up' ELSE 'down' END AS want FROM ev),
mt AS (SELECT 0::BIGINT AS n, NULL::DATE AS no2_date, NULL::VARCHAR AS direction, NULL::DATE AS prod_date, NULL::VARCHAR AS cause, []::VARCHAR[] AS used UNION ALL
SELECT en.n, en.date, en.direction, b.date, b.cause, CASE WHEN b.date IS NULL THEN mt.used ELSE mt.used || [b.date::VARCHAR || en.want] END FROM mt JOIN en ON en.n = mt.n + 1
LEFT JOIN LATERAL (SELECT po.date, po.cause FROM po WHERE po.direction = en.want AND abs(po.date - en.date) <= 21 AND NOT list_contains(mt.used, po.date::VARCHAR || en.want) ORDER BY abs(po.date - en.date), po.date LIMIT 1) b ON true),
ma AS (SELECT no2_date, prod_date, direction, (prod_date - no2_date)::DOUBLE AS lead_days, cause FROM mt WHERE prod_date IS NOT NULL)"""


@query("J7, M27", f"WITH RECURSIVE {_MATCH} SELECT * FROM ma")
def match_events(spark, d):
    return _matched(spark, d)[2]


@query("A11, A12, M27, M31", f"""WITH RECURSIVE {_MATCH}, su AS (SELECT (SELECT count(*) FROM ev) AS n_no2, (SELECT count(*) FROM po) AS n_prod, count(*) AS n_matched, median(lead_days) AS median_lead_days, avg((lead_days > 0)::INT) AS lead_positive_frac FROM ma)
SELECT n_no2, n_prod, n_matched, round(n_matched / n_no2, 6) AS precision, round(n_matched / n_prod, 6) AS recall, round(1 - n_matched / n_no2, 6) AS false_discovery_rate, round(median_lead_days, 6) AS median_lead_days, round(lead_positive_frac, 6) AS lead_positive_frac,
CASE WHEN n_matched = 0 OR n_matched / n_no2 < 0.3 THEN 'null' WHEN median_lead_days > 1 AND lead_positive_frac >= 0.5 THEN 'lead' ELSE 'coincident' END AS conclusion FROM su""")  # fmt: skip
def match_summary(spark, d):
    return rounded(e.conclusion(e.match_summary(*_matched(spark, d))))


@query("Q5, M33", f"""WITH RECURSIVE {_MATCH}, su AS (SELECT (SELECT count(*) FROM ev) AS n_no2, (SELECT count(*) FROM po) AS n_prod, count(*) AS n_matched, median(lead_days) AS median_lead_days, avg((lead_days > 0)::INT) AS lead_positive_frac FROM ma)
SELECT n_no2, n_prod, n_matched, round(median_lead_days, 6) AS median_lead_days, CASE WHEN n_matched = 0 OR n_matched / n_no2 < 0.3 THEN 'null' WHEN median_lead_days > 1 AND lead_positive_frac >= 0.5 THEN 'lead' ELSE 'coincident' END AS conclusion FROM su""")  # fmt: skip
def catalyst_run(spark, d):
    """A whole event study, up to its summary."""
    from tephra.plans.pipelines import catalyst

    residual = fr.signal(spark, d).withColumnRenamed("value", "residual_activity")
    out = catalyst(residual, fr.target(spark, d), None, _calendar(spark), z_thresh=1.0, match_window=3, min_events=1)["summary"]
    return rounded(out.select("n_no2", "n_prod", "n_matched", "median_lead_days", "conclusion"))


@query("F18", f"WITH RECURSIVE {_MATCH} SELECT date, direction, date IN (SELECT no2_date FROM ma) AS confirmed FROM ev")
def confirmed_events(spark, d):
    found, _, matched = _matched(spark, d)
    return e.confirm(found, matched).select("date", "direction", "confirmed")


_RETURNS = f"""{fr.SIGNAL_DAYS}, px AS (SELECT l_returnflag AS symbol, date, avg(value) AS close FROM sd GROUP BY 1, 2 UNION ALL SELECT 'ALL', date, avg(value) FROM sd GROUP BY 2), se AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM px)),
nb AS (SELECT symbol, date, close, k, lag(k) OVER w AS pk, lag(close) OVER w AS pc FROM px JOIN se USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY k)), rt AS (SELECT symbol, date, CASE WHEN pk = k - 1 THEN close / pc - 1 END AS ret FROM nb),
ar AS (SELECT a.symbol, a.date, a.ret, a.ret - m.ret AS ab FROM rt a JOIN rt m ON m.symbol = 'ALL' AND m.date = a.date WHERE a.symbol <> 'ALL' AND a.ret - m.ret IS NOT NULL)"""


@query("M28, W4", f"WITH {_RETURNS} SELECT symbol, date, round(ret, 6) AS ret, round(ab, 6) AS abnormal_return FROM ar")
def abnormal_returns(spark, d):
    return rounded(e.abnormal_returns(fr.prices(spark, d), "ALL"))


def _cars(spark, d):
    return e.forward_car(e.detect(fr.signal(spark, d), "value", SERIES, z_thresh=1.0), e.abnormal_returns(fr.prices(spark, d), "ALL"))


_CARS = f"""{_RETURNS}, {fr.regular('sg', 'sd', {'value': 'avg(value)'})}, {_z('sg', 'value', 12, 'zs')}, ev AS (SELECT date, CASE WHEN z >= 0 THEN 'surge' ELSE 'drop' END AS direction FROM zs WHERE abs(z) >= 1.0),
fw AS (SELECT i.symbol, ev.date, ev.direction, ar.ab, row_number() OVER (PARTITION BY i.symbol, ev.date ORDER BY ar.date) AS n FROM ev CROSS JOIN (SELECT DISTINCT symbol FROM ar) i LEFT JOIN ar ON ar.symbol = i.symbol AND ar.date >= ev.date + 2),
ca AS (SELECT symbol AS instrument, date AS event_date, direction, sum(ab) AS car FROM fw WHERE n <= 5 GROUP BY ALL), pe AS (SELECT *, CASE WHEN car IS NOT NULL THEN sign(car) = CASE direction WHEN 'surge' THEN 1 ELSE -1 END END AS hit FROM ca)"""


@query("J8, M29, J10", f"WITH {_CARS} SELECT instrument, event_date, direction, round(car, 6) AS car, hit FROM pe")
def forward_returns(spark, d):
    return rounded(_cars(spark, d))


@query("A13, M29", f"WITH {_CARS} SELECT instrument, count(car) AS n_events, round(avg(car), 6) AS car_mean, round(avg(hit::INT), 6) AS hit_rate FROM pe GROUP BY 1")
def event_study(spark, d):
    return rounded(e.study(_cars(spark, d)))


@query("M30, M31")
def event_study_intervals(spark, d):
    cars = _cars(spark, d)
    return rounded(e.study(cars).join(e.mean_intervals(cars.where("car is not null"), "car", ["instrument"]), "instrument"))


@query("M27, M30")
def lead_interval(spark, d):
    matched = _matched(spark, d)[2].withColumn("k", F.lit("all"))
    return rounded(e.mean_intervals(matched, "lead_days", ["k"]))


@query("M31")
def market_verdict(spark, d):
    cars = _cars(spark, d).where("car is not null")
    return e.market_verdict(e.mean_intervals(cars, "car", ["instrument"]))
