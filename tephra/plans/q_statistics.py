"""Queries of correlation, lead-lag, dependence and multiplicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.functions import statistics as st
from tephra.operators import correlate as c
from tephra.plans import frames as fr
from tephra.plans.frames import SERIES, rounded
from tephra.registry import query

_PAIR = fr.pair_sql()
_LAGGED = "lg AS (SELECT k AS lag, a.x, b.y FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM pr) b JOIN (SELECT unnest(range(-8, 9)) AS k) k ON true JOIN (SELECT *, row_number() OVER (ORDER BY date) AS n FROM pr) a ON a.n = b.n - k)"
_CCF = f"{_PAIR}, {_LAGGED}, cc AS (SELECT lag, corr(x, y) AS r, count(*) AS n FROM lg GROUP BY 1)"
_FISHER = "round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS ci_high"


@query("A5, M12, J1", f"WITH {_PAIR}, r AS (SELECT corr(x, y) AS r, count(*) AS n FROM pr) SELECT round(r, 6) AS r, n, {_FISHER} FROM r")
def correlate(spark, d):
    return rounded(c.correlate(fr.pair(spark, d), "x", "y", with_p=False))


@query("M12, M17")
def correlate_p(spark, d):
    return rounded(c.correlate(fr.pair(spark, d), "x", "y", SERIES).drop("series_id"))


@query("M12a", f"WITH {_PAIR}, r AS (SELECT corr(x, y) AS r, count(*) AS n FROM pr) SELECT round(r, 6) AS r, abs(r * sqrt((n - 2) / (1 - r * r))) > 1.9670 AS significant, CASE WHEN NOT abs(r * sqrt((n - 2) / (1 - r * r))) > 1.9670 THEN 'indeterminate' WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM r")
def verify_sign(spark, d):
    r = c.correlate(fr.pair(spark, d), "x", "y", with_p=False)
    beyond = F.abs(st.t_of_r(F.col("r"), F.col("n"))) > 1.9670
    return rounded(r.select("r", beyond.alias("significant"), st.sign_label(F.col("r"), beyond).alias("sign")))


@query("M13, T7, O3", f"WITH {_CCF} SELECT lag::INT AS lag, round(r, 6) AS r, n FROM cc")
def lead_lag(spark, d):
    return rounded(c.ccf(fr.pair(spark, d), "x", "y", 8, SERIES).select("lag", "r", "n"))


@query("M13, O3", f"WITH {_CCF} SELECT arg_max(lag, (abs(r), -lag))::INT AS peak_lag, round(arg_max(r, (abs(r), -lag)), 6) AS peak_r, max(n) FILTER (lag = 0) AS n_overlap, round(1.96 / sqrt(max(n) FILTER (lag = 0)), 6) AS band FROM cc")
def lead_lag_peak(spark, d):
    return rounded(c.peak(c.ccf(fr.pair(spark, d), "x", "y", 8, SERIES), SERIES).drop("series_id"))


@query("M31, F17", f"WITH {_CCF}, p AS (SELECT arg_max(lag, (abs(r), -lag)) AS l, arg_max(r, (abs(r), -lag)) AS r, max(r) FILTER (lag = 0) AS r0, max(n) FILTER (lag = 0) AS n FROM cc) SELECT CASE WHEN NOT abs(r0 * sqrt((n - 2) / (1 - r0 * r0))) > 1.9670 OR abs(r) < 0.5 THEN 'null' WHEN l > 0 THEN 'lead' ELSE 'concurrent' END AS conclusion, CASE WHEN abs(r) >= 0.75 THEN 'above-bar' WHEN abs(r) >= 0.5 THEN 'in-band' ELSE 'below-bar' END AS bar FROM p")
def validation_conclusion(spark, d):
    table = c.ccf(fr.pair(spark, d), "x", "y", 8, SERIES)
    zero = table.where("lag = 0").select(*SERIES, F.col("r").alias("r0"), "n")
    both = c.peak(table, SERIES).join(zero, SERIES)
    beyond = F.abs(st.t_of_r(F.col("r0"), F.col("n"))) > 1.9670
    return both.select(st.lead_conclusion(beyond, F.col("peak_r"), F.col("peak_lag"), (0.5, 0.75)).alias("conclusion"), st.bar_class(F.col("peak_r"), (0.5, 0.75)).alias("bar"))


@query("Q4, M33", f"WITH {_CCF}, p AS (SELECT arg_max(lag, (abs(r), -lag)) AS l, arg_max(r, (abs(r), -lag)) AS pr, max(r) FILTER (lag = 0) AS r, max(n) FILTER (lag = 0) AS n FROM cc) SELECT round(r, 6) AS r, n, {_FISHER}, l::INT AS peak_lag, round(pr, 6) AS peak_r, round(1.96 / sqrt(n), 6) AS band, CASE WHEN NOT abs(r * sqrt((n - 2) / (1 - r * r))) > 1.9670 THEN 'indeterminate' WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM p")
def validation_run(spark, d):
    """A whole validation as the one row of its payload."""
    from tephra.plans.pipelines import validate

    index, target = fr.signal(spark, d).select("date", F.col("value").alias("index_value")), fr.target(spark, d).select("date", "value")
    out = validate(index, target)
    names = ("r", "n", "ci_low", "ci_high", "peak_lag", "peak_r", "band", "sign")
    row = spark.createDataFrame([tuple(out[c] for c in names)], "r double, n long, ci_low double, ci_high double, peak_lag int, peak_r double, band double, sign string")
    return rounded(row)


_ACF = "cx AS (SELECT date, x - avg(x) OVER () AS c FROM pr), la AS (SELECT k, c, lag(c, k) OVER (PARTITION BY k ORDER BY date) AS b FROM cx, (SELECT unnest(range(1, 6))::INT AS k)), ac AS (SELECT k AS lag, sum(c * b) / sum(c * c) AS rho FROM la GROUP BY 1)"


@query("M14", f"WITH {_PAIR}, {_ACF} SELECT lag, round(rho, 6) AS rho FROM ac")
def autocorrelation(spark, d):
    return rounded(c.autocorrelations(fr.pair(spark, d), "x", 5, SERIES).select("lag", "rho"))


@query("M14", f"WITH {_PAIR}, l AS (SELECT x, lag(x) OVER (ORDER BY date) AS b FROM pr) SELECT round(corr(x, b), 6) AS lag1 FROM l")
def autocorrelation_lag1(spark, d):
    return rounded(c.lag1_by_corr(fr.pair(spark, d), "x", SERIES).select("lag1"))


@query("M16", fr.effective_n_sql("n_eff_first", "n_eff_nw"))
def effective_n(spark, d):
    return rounded(c.effective_n(fr.pair(spark, d), "x", "y", SERIES).drop("series_id"), 4)


@query("M20, W6", """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 17 <> 0 THEN round(p_retailprice / (SELECT max(p_retailprice) FROM part) * (p_size / 50.0::DOUBLE), 9) END AS p FROM part),
r AS (SELECT *, p * count(p) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS rough FROM p WHERE p IS NOT NULL),
a AS (SELECT p_partkey, least(1.0, min(rough) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT p.p_partkey, round(q, 6) AS p_fdr, coalesce(q <= 0.05, false) AS fdr_reject FROM p LEFT JOIN a USING (p_partkey)""")  # fmt: skip
def fdr(spark, d):
    p = fr.table(spark, d, "part")
    top = p.agg(F.max("p_retailprice").alias("top"))
    p = p.crossJoin(F.broadcast(top)).withColumn("p", F.when(F.col("p_partkey") % 17 != 0, F.round(F.col("p_retailprice") / F.col("top") * (F.col("p_size") / 50.0), 9)))
    return rounded(c.bh_fdr(p, "p", ["p_brand"], 0.05, ["p_partkey"]).select("p_partkey", "p_fdr", "fdr_reject"))


_LONG = f"{fr.SIGNAL_DAYS}, lo AS (SELECT last_day(date) AS date, substr(p_brand, 1, 8) AS name, avg(value) AS value FROM sd JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


def _by_brand(spark, d):
    days = fr.signal_days(spark, d).join(fr.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 1, 8).alias("name")), "l_partkey")
    return days.groupBy(F.last_day("date").alias("date"), "name").agg(F.avg("value").alias("value"))


_MATRIX = f"{_LONG}, ok AS (SELECT name FROM lo GROUP BY 1 HAVING count(*) > 12), mx AS (SELECT a.name AS a, b.name AS b, corr(a.value, b.value) AS r, count(*) AS n FROM lo a JOIN lo b ON a.date = b.date AND a.name < b.name WHERE a.name IN (FROM ok) AND b.name IN (FROM ok) GROUP BY 1, 2)"


@query("A6", f"WITH {_MATRIX} SELECT a, b, round(r, 6) AS r, n FROM mx")
def correlation_matrix(spark, d):
    return rounded(c.matrix(_by_brand(spark, d)))


@query("A6, O2", f"WITH {_MATRIX} SELECT a, b, round(r, 6) AS r, n FROM mx WHERE abs(mx.r) >= 0.1 ORDER BY abs(mx.r) DESC, a, b LIMIT 15")
def strongest_pairs(spark, d):
    return rounded(c.strongest(c.matrix(_by_brand(spark, d)), 0.1, 15))


@query("M39", f"""WITH {_LONG}, tg AS (SELECT last_day(o_orderdate::DATE) AS date, avg(o_totalprice) AS y FROM orders GROUP BY 1), pr AS (SELECT name, date, value AS x, y, row_number() OVER (PARTITION BY name ORDER BY date) AS n FROM lo JOIN tg USING (date)),
lg AS (SELECT b.name, k AS lag, a.x, b.y FROM pr b, (SELECT unnest(range(-3, 4)) AS k) k, pr a WHERE a.name = b.name AND a.n = b.n - k)
SELECT name, lag::INT AS lag, round(CASE WHEN count(*) >= 3 THEN corr(x, y) ELSE 0 END, 6) AS r, count(*) AS n FROM lg GROUP BY 1, 2""")  # fmt: skip
def ccf_by_driver(spark, d):
    y = fr.target_days(spark, d).groupBy(F.last_day("date").alias("date")).agg(F.avg("value").alias("y"))
    return rounded(c.ccf(_by_brand(spark, d).withColumnRenamed("value", "x").join(y, "date"), "x", "y", 3, ["name"]))


@query("M42", f"WITH {_PAIR} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 3) AS intercept FROM pr")
def scatter_line(spark, d):
    s = c.fit_line(fr.pair(spark, d), "y", "x")
    return rounded(s).withColumn("intercept", F.round("intercept", 3))


@query("M32", f"WITH {_PAIR}, df AS (SELECT x, y, x - lag(x, 52) OVER (ORDER BY date) AS e FROM pr) SELECT round(corr(x, y), 6) AS levels_r, round(corr(e, y), 6) AS residual_r, count(*) AS n, coalesce(corr(x, y) < 0 AND corr(e, y) > 0, false) AS decoupled FROM df")
def levels_relationship(spark, d):
    from tephra.operators.series import difference

    return rounded(c.levels_relationship(difference(fr.pair(spark, d), "x", 52, SERIES, name="e"), "e", "x", "y"))
