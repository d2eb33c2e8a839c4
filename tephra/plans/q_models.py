"""Queries of index building, fitted models and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.config import ACTIVE_STATUS
from tephra.operators import correlate as co
from tephra.operators import grid as g
from tephra.operators import index as ix
from tephra.operators import sweep as sw
from tephra.operators import trend as tr
from tephra.plans import frames as fr
from tephra.plans import pipelines as pl
from tephra.plans.frames import SERIES, rounded
from tephra.registry import query
from tephra.sources.scratch import stored

_SG = f"{fr.SIGNAL_DAYS}, {fr.regular('sg', 'sd', {'value': 'avg(value)'})}"
_SW = f"{_SG}, {fr.weather_sql()}"


def _with_weather(spark, d):
    return fr.signal(spark, d).join(fr.weather(spark, d), ["series_id", "date"], "left")


@query("M4a, T8", f"WITH {_SG} SELECT date, round(value - lag(value, 52) OVER (ORDER BY date), 6) AS deseasoned FROM sg")
def deseason_yoy(spark, d):
    return rounded(ix.deseasonalise(fr.signal(spark, d), "value", SERIES, "yoy").select("date", "deseasoned"))


@query("M4b", f"WITH {_SG}, y AS (SELECT date, value - lag(value, 52) OVER (ORDER BY date) AS v FROM sg) SELECT date, round(v - lag(v) OVER (ORDER BY date), 6) AS deseasoned FROM y")
def deseason_double_diff(spark, d):
    return rounded(ix.deseasonalise(fr.signal(spark, d), "value", SERIES, "yoy-double-diff").select("date", "deseasoned"))


@query("M4g", f"WITH {_SG} SELECT date, round(value, 6) AS deseasoned FROM sg")
def deseason_none(spark, d):
    return rounded(ix.deseasonalise(fr.signal(spark, d), "value", SERIES, "none").select("date", "deseasoned"))


@query("M5, F14", f"WITH {_SG}, h AS (SELECT date, value, month(date) IN (11, 12, 1, 2, 3) AS heating FROM sg) SELECT date, round(value - avg(value) OVER (PARTITION BY heating), 6) AS value FROM h")
def without_heating(spark, d):
    return rounded(ix.without_heating(fr.signal(spark, d), "value", (11, 12, 1, 2, 3), SERIES).select("date", "value"))


_TWO = """c AS (SELECT date, value, u10, v10, avg(value) OVER () AS my, avg(u10) OVER () AS ma, avg(v10) OVER () AS mb FROM j WHERE value IS NOT NULL AND u10 IS NOT NULL AND v10 IS NOT NULL),
q AS (SELECT sum((u10 - ma) * (u10 - ma)) AS aa, sum((v10 - mb) * (v10 - mb)) AS bb, sum((u10 - ma) * (v10 - mb)) AS ab, sum((u10 - ma) * (value - my)) AS ay, sum((v10 - mb) * (value - my)) AS byy FROM c),
k AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS p, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM q)"""
_TERMS = _TWO.replace("u10", "heating").replace("v10", "curtailment")


@query("M5, F15", f"""WITH {_SG}, j AS (SELECT date, value, (month(date) IN (11, 12, 1, 2, 3))::INT AS heating, (date BETWEEN date '1996-02-04' AND date '1997-03-03')::INT AS curtailment FROM sg), {_TERMS}
SELECT date, round(value - my - k.p * (heating - ma) - k.q * (curtailment - mb), 4) AS value FROM c, k UNION ALL SELECT date, NULL FROM j WHERE value IS NULL""")  # fmt: skip
def without_two_terms(spark, d):
    from tephra.functions.calendar import heating_season

    calendar = spark.sql("select date '1996-02-04' as `start`, date '1997-03-03' as `end`")
    s = ix.in_interval(fr.signal(spark, d).withColumn("heating", heating_season(F.col("date"), (11, 12, 1, 2, 3))), calendar)
    return rounded(ix.without_terms(s, "value", ["heating", "curtailment"], SERIES).select("date", "value"), 4)


@query("F15", f"WITH {_SG} SELECT date, NULL::DOUBLE AS curtailment FROM sg")
def curtailment_unknown(spark, d):
    """Without a calendar the control is NULL on every date."""
    return ix.in_interval(fr.signal(spark, d), None).select("date", "curtailment")


@query("M2", f"WITH {_SW}, j AS (SELECT date, value, blh FROM sg LEFT JOIN we USING (date)), r AS (SELECT regr_slope(value, blh) AS s, regr_intercept(value, blh) AS i FROM j) SELECT date, round(value - i - s * blh, 5) AS residual FROM j, r")
def residual_one_covariate(spark, d):
    return rounded(ix.residual_simple(_with_weather(spark, d), "value", "blh", SERIES).select("date", "residual"), 5)


@query("M1", f"WITH {_SW}, j AS (SELECT date, value, u10, v10 FROM sg LEFT JOIN we USING (date)), {_TWO} SELECT date, round(value - my - k.p * (u10 - ma) - k.q * (v10 - mb), 4) AS residual FROM c, k UNION ALL SELECT date, NULL FROM j WHERE value IS NULL OR u10 IS NULL OR v10 IS NULL")
def regress_out_linear(spark, d):
    return rounded(tr.regress_out(_with_weather(spark, d), "value", ["u10", "v10"], SERIES).select("date", "residual"), 4)


@query("M1, M3")
def regress_out_loess(spark, d):
    return rounded(tr.regress_out(_with_weather(spark, d), "value", ["blh"], SERIES, "loess").select("date", "residual"))


@query("M6a, M6b, M4d", f"WITH {_SG}, o AS (SELECT date, value, (row_number() OVER (ORDER BY date) - 1) / (count(*) OVER () - 1) AS t FROM sg WHERE value IS NOT NULL), r AS (SELECT regr_slope(value, t) AS s, regr_intercept(value, t) AS i FROM o) SELECT sg.date, round(t, 6) AS t, round(i + s * t, 2) AS trend, round(sg.value - i - s * t, 3) AS residual FROM sg LEFT JOIN o USING (date), r")
def linear_trend(spark, d):
    out = ix.linear_trend(fr.signal(spark, d), "value", SERIES)
    return rounded(rounded(out.select("date", "t", "trend", "residual"), 6).withColumn("trend", F.round("trend", 2)).withColumn("residual", F.round("residual", 3)))


@query("M6, M6d, M4d, M8")
def intensity_trend(spark, d):
    return rounded(tr.intensity_trend(fr.signal(spark, d), "value", SERIES).drop("series_id"))


@query("M6e, M6")
def intensity_trend_gcv(spark, d):
    return rounded(tr.intensity_trend(fr.signal(spark, d, "ME"), "value", SERIES, criterion="gcv").drop("series_id"))


@query("M6c, M6")
def intensity_trend_loess(spark, d):
    return rounded(tr.intensity_trend(fr.signal(spark, d, "ME"), "value", SERIES, estimator="loess").drop("series_id"))


@query("M7, M12, M13")
def smoothness_sweep(spark, d):
    pair = fr.pair(spark, d, "ME")
    residuals = tr.smoothness_residuals(pair.select("series_id", "date", "x"), "x", SERIES).join(pair, ["series_id", "date"])
    by = ["series_id", "df"]
    r = co.correlate(residuals, "residual", "y", by).select(*by, F.col("r").alias("residual_r"), F.col("p").alias("residual_p"))
    peak = co.peak(co.ccf(residuals, "residual", "y", 8, by), by).select(*by, "peak_lag", "peak_r")
    levels = co.correlate(pair, "x", "y", SERIES, with_p=False).select(*SERIES, F.col("r").alias("levels_r"))
    return rounded(r.join(peak, by).join(levels, SERIES).drop("series_id"), 4)


@query("M4c")
def deseason_stl(spark, d):
    return rounded(ix.deseasonalise(fr.signal(spark, d, "ME"), "value", SERIES, "stl", 12).select("date", "deseasoned"))


@query("M11", f"""WITH {fr.TARGET_DAYS}, dy AS (SELECT date, avg(value) AS value FROM td GROUP BY 1), p AS (SELECT *, cos(2 * pi() * dayofyear(date) / 365.25) AS c, sin(2 * pi() * dayofyear(date) / 365.25) AS s FROM dy),
z AS (SELECT date, c - avg(c) OVER () AS c, s - avg(s) OVER () AS s, value - avg(value) OVER () AS y FROM p), q AS (SELECT sum(c * c) AS cc, sum(s * s) AS ss, sum(c * s) AS cs, sum(c * y) AS cy, sum(s * y) AS sy FROM z)
SELECT date, round(y - (cy * ss - sy * cs) / (cc * ss - cs * cs) * c - (sy * cc - cy * cs) / (cc * ss - cs * cs) * s, 5) AS residual FROM z, q""")  # fmt: skip
def harmonic_step(spark, d):
    days = fr.target_days(spark, d).groupBy("series_id", "date").agg(F.avg("value").alias("value"))
    return rounded(ix.harmonic_one(days, "value", SERIES).select("date", "residual"), 5)


@query("M11, M4f")
def deseason_harmonic(spark, d):
    return rounded(ix.deseasonalise(fr.signal(spark, d), "value", SERIES, "harmonic").select("date", "deseasoned"))


@query("M9, M4e, A10")
def additive_decomposition(spark, d):
    days = fr.target_days(spark, d).groupBy("series_id", "date").agg(F.avg("value").alias("value"))
    return rounded(tr.additive_deseason(days, "value", SERIES).drop("series_id"))


@query("M10")
def additive_causal(spark, d):
    days = fr.target_days(spark, d).groupBy("series_id", "date").agg(F.avg("value").alias("value"))
    return rounded(tr.additive_causal(days, "value", SERIES).drop("series_id"))


@query("M22", f"WITH {_SG} SELECT date, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS index_value FROM sg")
def index_zscore(spark, d):
    return rounded(ix.build_index(fr.signal(spark, d), "value", SERIES).select("date", "index_value"))


@query("M22", f"WITH {_SG} SELECT date, round(value / (SELECT avg(value) FROM sg WHERE date::VARCHAR LIKE '1997%') * 100, 6) AS index_value FROM sg")
def index_anchored(spark, d):
    return rounded(ix.build_index(fr.signal(spark, d), "value", SERIES, "1997").select("date", "index_value"))


@query("Q2, M1, M4, M22")
def activity_index(spark, d):
    s = fr.signal(spark, d).select("date", F.col("value").alias("no2_corrected"), F.lit(None).cast("double").alias("valid_coverage"))
    return rounded(pl.activity_index(s, fr.weather(spark, d)).drop("series_id"))


@query("M16, M21, M12", fr.effective_n_sql("n_eff_first", "n_eff_nw", "r"))
def robust_sizes(spark, d):
    """The parts of the robust correlation that aren't resampled."""
    rows = sw.robust_correlations(fr.pair(spark, d), "x", "y", SERIES, draws_boot=20, draws_perm=20).where("lag_kind = 'lag0'")
    return rounded(rows.select(F.col("n").cast("long").alias("n"), "r", "n_eff_first", "n_eff_nw"), 4)


@query("M18, M19, M21, M17, M41")
def robust_correlation(spark, d):
    rows = sw.robust_correlations(fr.pair(spark, d), "x", "y", SERIES)
    return rounded(sw.dependence_verdict(rows).drop("series_id"))


@query("M35, M37, M40, A15")
def battery(spark, d):
    """Weather x season x frequency: the signal as it is and without weather."""
    raw = fr.signal(spark, d).select("series_id", "date", "value")
    free = tr.regress_out(_with_weather(spark, d), "value", ["u10", "v10", "blh"], SERIES).select("series_id", "date", F.col("residual").alias("value"))
    both = raw.withColumn("meteo", F.lit("none")).unionByName(free.withColumn("meteo", F.lit("linear"))).drop("series_id")
    return rounded(pl.sweep_rows(both, fr.target_days(spark, d), ["meteo"], ["W", "ME"], ["level", "yoy", "intensity", "stl", "yoy-double-diff"]))


def _sweep(spark, d):
    cube = stored(fr.cube(spark, d), "cube")
    fac = g.active(fr.facilities(spark, d), ACTIVE_STATUS)
    return pl.scale_sweep(cube, fr.target_days(spark, d).withColumn("date", F.date_add("date", 9135)), fac)


@query("M36, M20, M34, M35")
def scale_sweep(spark, d):
    return rounded(_sweep(spark, d))


@query("A14, M36")
def scale_findings(spark, d):
    return pl.robust_changes(stored(_sweep(spark, d), "sweep"))  # read twice, as all rows and as those of the native grid


_FOUND = """v AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'native' WHEN 1 THEN '0.15' ELSE '0.25' END AS resolution, l_returnflag AS variant, l_linestatus AS freq, 0.25::DOUBLE AS buffer, 'lag0' AS lag_kind, avg(l_discount) - avg(l_tax) * 1.2345 AS r,
CASE count(*) % 3 WHEN 0 THEN 'robust' WHEN 1 THEN 'fragile (naive-only)' ELSE 'ns' END AS verdict FROM lineitem GROUP BY ALL)"""


@query("A14", f"WITH {_FOUND} SELECT v.resolution, count(*) AS n, count(*) FILTER (v.verdict = 'robust') AS robust, count(*) FILTER (v.verdict LIKE 'fragile%') AS naive_only, count(*) FILTER (sign(v.r) <> sign(n.r)) AS sign_changes FROM v LEFT JOIN (FROM v WHERE resolution = 'native') n USING (buffer, freq, variant, lag_kind) GROUP BY 1")
def sign_changes(spark, d):
    """Findings over the rows of a sweep, here made of aggregates of lines."""
    part = F.when(F.col("l_linenumber") % 3 == 0, "native").when(F.col("l_linenumber") % 3 == 1, "0.15").otherwise("0.25")
    n = F.count("*") % 3
    rows = fr.table(spark, d, "lineitem").groupBy(part.alias("resolution"), F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("freq")).agg((F.avg("l_discount") - F.avg("l_tax") * 1.2345).alias("r"), F.when(n == 0, "robust").when(n == 1, "fragile (naive-only)").otherwise("ns").alias("verdict"))
    return pl.robust_changes(rows.withColumn("buffer", F.lit(0.25)).withColumn("lag_kind", F.lit("lag0")))
