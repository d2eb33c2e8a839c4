"""Queries of time bucketing, alignment and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tephra.functions import calendar as cal
from tephra.functions import cleaning as cl
from tephra.functions import statistics as st
from tephra.operators import series as op
from tephra.plans import frames as fr
from tephra.plans.frames import SERIES, rounded
from tephra.registry import query

_SG = f"{fr.SIGNAL_DAYS}, {fr.regular('sg', 'sd', {'value': 'avg(value)'})}"


def _resampled(freq):
    return f"WITH {fr.SIGNAL_DAYS}, {fr.regular('sg', 'sd', {'value': 'avg(value)'}, freq)} SELECT date, round(value, 6) AS value FROM sg"


@query("T1, A1, O1", _resampled("W"))
def resample_week(spark, d):
    return rounded(fr.signal(spark, d).select("date", "value"))


@query("T1", _resampled("ME"))
def resample_month(spark, d):
    return rounded(fr.signal(spark, d, "ME").select("date", "value"))


@query("T1", _resampled("D"))
def resample_day(spark, d):
    return rounded(fr.signal(spark, d, "D").select("date", "value"))


@query("T1, T3, G15", """WITH e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT hour, event_type, round(avg(v), 6) AS value, count(v) AS valid, count(*) AS total, round(count(v) / count(*), 6) AS coverage FROM e GROUP BY 1, 2""")  # fmt: skip
def hourly_coverage(spark, d):
    e = fr.table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return rounded(e.groupBy("hour", "event_type").agg(F.avg("v").alias("value"), F.count("v").alias("valid"), F.count("*").alias("total"), (F.count("v") / F.count("*")).alias("coverage")))


@query("T2, W4", f"""WITH {fr.SIGNAL_DAYS}, p AS (SELECT l_returnflag AS symbol, date, avg(value) AS close FROM sd GROUP BY 1, 2 UNION ALL SELECT 'ALL', date, avg(value) FROM sd GROUP BY 2),
m AS (SELECT symbol, last_day(date) AS period, arg_max(close, date) AS close FROM p GROUP BY 1, 2),
s AS (SELECT symbol, last_day(t::DATE) AS period FROM (SELECT symbol, unnest(generate_series(date_trunc('month', min(period)), date_trunc('month', max(period)), INTERVAL 1 MONTH)) AS t FROM m GROUP BY symbol))
SELECT symbol, period AS date, round(close, 6) AS close, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY period) - 1, 6) AS ret FROM s LEFT JOIN m USING (symbol, period)""")  # fmt: skip
def resample_last_return(spark, d):
    return rounded(op.pct_change(op.resample_last(fr.prices(spark, d), "ME", "close", ["symbol"]), "close", ["symbol"]))


@query("T4, F19", f"""WITH {fr.cube_sql()} SELECT count(DISTINCT period) AS have, 100::BIGINT AS expected, round(least(count(DISTINCT period) / 100, 1.0), 6) AS fraction FROM cube WHERE coverage IS NOT NULL""")
def completeness(spark, d):
    return rounded(op.completeness(fr.cube(spark, d), "2020-01-05", "2021-11-28", "W", "period"))


@query("T6", """WITH s AS (SELECT unnest(generate_series(date '2019-01-01', date '2020-03-01', INTERVAL 1 MONTH))::DATE AS m)
SELECT greatest(m, date '2019-01-15') AS start, least((m + INTERVAL 1 MONTH)::DATE, date '2020-03-20') AS stop FROM s""")  # fmt: skip
def month_batches(spark, d):
    return op.month_batches(spark.sql("select date '2019-01-15' as first, date '2020-03-20' as last"))


@query("T7, T8, W4", f"""WITH {_SG} SELECT date, round(lag(value, 3) OVER (ORDER BY date), 6) AS before, round(lead(value, 2) OVER (ORDER BY date), 6) AS after, round(value - lag(value, 4) OVER (ORDER BY date), 6) AS diff FROM sg""")
def shifts(spark, d):
    s = op.shift(op.shift(fr.signal(spark, d), "value", 3, SERIES, name="before"), "value", -2, SERIES, name="after")
    return rounded(op.difference(s, "value", 4, SERIES, name="diff").select("date", "before", "after", "diff"))


@query("T9, F14, A7", f"""WITH {fr.TARGET_DAYS}, dy AS (SELECT date, avg(value) AS value FROM td GROUP BY 1)
SELECT 'weekday' AS part, (isodow(date) - 1)::INT AS k, round(avg(value), 6) AS effect FROM dy GROUP BY 2 UNION ALL SELECT 'month', month(date)::INT, round(avg(value), 6) FROM dy GROUP BY 2
UNION ALL SELECT 'heating', (month(date) IN (11, 12, 1, 2, 3))::INT, round(avg(value), 6) FROM dy GROUP BY 2""")  # fmt: skip
def climatology(spark, d):
    days = fr.target_days(spark, d).groupBy("date").agg(F.avg("value").alias("value"))
    parts = [("weekday", F.weekday("date")), ("month", F.month("date")), ("heating", cal.heating_season(F.col("date"), (11, 12, 1, 2, 3)).cast("int"))]
    out = None
    for name, part in parts:
        own = op.climatology(days, "value", part, "k").select(F.lit(name).alias("part"), F.col("k").cast("int").alias("k"), "effect")
        out = own if out is None else out.unionByName(own)
    return rounded(out)


@query("T10, T11", """SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price FROM orders GROUP BY 1""")
def dedup_first_last(spark, d):
    o = fr.table(spark, d, "orders")
    last = op.dedup(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_totalprice").alias("last_price"))
    first = op.dedup(o, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", F.col("o_totalprice").alias("first_price"))
    return last.join(first, "o_custkey")


@query("T12, T13, F16", """SELECT DISTINCT strftime(date_trunc('day', ts), '%Y-%m-%dT%H%M%S') AS id, CASE WHEN ts::DATE < date '2022-07-01' THEN 'v1.x' ELSE 'v2.x' END AS version,
ts::DATE AS day FROM events""")  # fmt: skip
def observation_ids(spark, d):
    e = fr.table(spark, d, "events").select(F.date_trunc("day", "ts").alias("time")).distinct()
    path = F.concat(F.lit("/store/"), F.date_format("time", "yyyy"), F.lit("/snap_"), F.date_format("time", "yyyy-MM-dd"), F.lit(".csv"))
    return e.select(cal.observation_id(F.col("time")).alias("id"), cal.processor_label(F.lit(None).cast("string"), F.col("time")).alias("version"), cal.snapshot_date(path).alias("day"))


@query("J1, M23, F8", f"""WITH {fr.SIGNAL_DAYS}, {fr.TARGET_DAYS}, sv AS (SELECT date, avg(value) AS v, avg((l_discount > 0.02)::INT) AS cov FROM sd GROUP BY 1), sc AS (SELECT date, CASE WHEN NOT cov < 0.7 THEN v END AS value FROM sv),
{fr.regular('sg', 'sc', {'value': 'avg(value)'})}, {fr.regular('tg', 'td', {'value': 'avg(value)'})} SELECT date, round(sg.value, 5) AS index, round(tg.value, 5) AS benchmark FROM sg JOIN tg USING (date) WHERE sg.value IS NOT NULL AND tg.value IS NOT NULL""")  # fmt: skip
def align_screened(spark, d):
    days = fr.signal_days(spark, d).groupBy("date").agg(F.avg("value").alias("v"), F.avg((F.col("l_discount") > 0.02).cast("double")).alias("cov"))
    screened = days.select("date", cl.coverage_screen(F.col("v"), F.col("cov"), 0.7).alias("value"))
    left = op.resample(screened, "W", ["value"]).withColumnRenamed("value", "index")
    right = op.resample(fr.target_days(spark, d), "W", ["value"]).withColumnRenamed("value", "benchmark")
    return rounded(op.align(left, right), 5)


@query("J2, J3, J4", f"""WITH {fr.pair_sql()}, {fr.weather_sql()} SELECT date, round(sg.value, 5) AS signal, round(tg.value, 5) AS target, round(we.blh, 5) AS blh FROM sg FULL JOIN tg USING (date) FULL JOIN we USING (date)""")
def master_frame(spark, d):
    parts = [fr.signal(spark, d).select("date", F.col("value").alias("signal")), fr.target(spark, d).select("date", F.col("value").alias("target")), fr.weather(spark, d).select("date", "blh")]
    return rounded(op.outer_align(parts), 5)


@query("W3, A15", f"""WITH {fr.pair_sql()}, c AS (SELECT date, CASE WHEN count(*) OVER w = 18 THEN corr(x, y) OVER w END AS r FROM pr WINDOW w AS (ORDER BY date ROWS BETWEEN 17 PRECEDING AND CURRENT ROW))
SELECT date, round(r, 6) AS r, round(max(abs(r)) OVER (), 6) AS peak FROM c""")  # fmt: skip
def rolling_correlation(spark, d):
    r = op.rolling_corr(fr.pair(spark, d), "x", "y", 18, SERIES)
    return rounded(r.select("date", "r", F.max(F.abs("r")).over(Window.partitionBy("series_id")).alias("peak")))


@query("A8, A9, S14, O7", f"""WITH {fr.SIGNAL_DAYS}, p AS (SELECT l_returnflag AS symbol, last_day(date) AS date, avg(value) AS close FROM sd GROUP BY 1, 2)
SELECT date, round(max(close) FILTER (symbol = 'A'), 6) AS "A", round(max(close) FILTER (symbol = 'N'), 6) AS "N", round(max(close) FILTER (symbol = 'R'), 6) AS "R" FROM p GROUP BY 1""")  # fmt: skip
def pivot_prices(spark, d):
    monthly = fr.signal_days(spark, d).groupBy(F.col("l_returnflag").alias("symbol"), F.last_day("date").alias("date")).agg(F.avg("value").alias("close"))
    wide = op.pivot_last(monthly, ["date"], "symbol", ["A", "N", "R"], "close", "date")
    again = op.pivot_last(op.melt(wide, ["date"], ["A", "N", "R"], "symbol", "close"), ["date"], "symbol", ["A", "N", "R"], "close", "date")
    return rounded(again)


@query("A1, A2, A3, A4, A10", f"""WITH {_SG} SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(median(value), 6) AS med, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi,
round(max(value) - min(value), 6) AS ptp, count(DISTINCT month(date)) AS months FROM sg""")  # fmt: skip
def summary_statistics(spark, d):
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    s = fr.signal(spark, d).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.percentile("value", F.lit(0.5)).alias("med"), q.alias("q"), (F.max("value") - F.min("value")).alias("ptp"), F.count_distinct(F.month("date")).alias("months"))
    return rounded(s.select("n", "mean", "sd", "med", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "ptp", "months"))


@query("M15, F17, A16, 2.10", """SELECT n, CASE WHEN n < 4 THEN greatest(1, n // 2) ELSE least(greatest(round_even(pow(n, 1 / 3.0::DOUBLE), 0)::INT, 2), greatest(2, n // 2)) END::INT AS block,
CASE WHEN n / 120.0 >= 0.75 THEN 'above-bar' WHEN n / 120.0 >= 0.5 THEN 'in-band' ELSE 'below-bar' END AS bar, round(sqrt(n / 121.0::DOUBLE), 6) AS ceiling FROM (SELECT unnest(range(1, 121))::INT AS n)""")  # fmt: skip
def scalar_rules(spark, d):
    n = F.col("id").cast("int")
    s = spark.range(1, 121).select(n.alias("n"))
    return rounded(s.select("n", st.block_length(F.col("n")).alias("block"), st.bar_class(F.col("n") / 120, (0.5, 0.75)).alias("bar"), st.snr_ceiling(F.col("n") / 121).alias("ceiling")))
