"""Stand-ins among the driver's tables for the things that the operators work on, in Spark and as SQL.

signal: line prices by ship date. target: order totals by order date. grid: embeddings as 8 x 8 grids, one a day.
facilities: suppliers on a lattice. prices: last line price by return flag and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.operators.series import resample

SERIES = ["series_id"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def signal_days(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.lit("signal").alias("series_id"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"), "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_partkey")


def target_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.lit("signal").alias("series_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))


def signal(spark: SparkSession, d: str, freq: str = "W") -> DataFrame:
    return resample(signal_days(spark, d), freq, ["value"], SERIES)


def target(spark: SparkSession, d: str, freq: str = "W") -> DataFrame:
    return resample(target_days(spark, d), freq, ["value"], SERIES)


def pair(spark: SparkSession, d: str, freq: str = "W") -> DataFrame:
    """(series_id, date, x, y) of signal and target on dates that both have."""
    a = signal(spark, d, freq).withColumnRenamed("value", "x")
    b = target(spark, d, freq).withColumnRenamed("value", "y")
    return a.join(b, ["series_id", "date"]).na.drop()


def weather(spark: SparkSession, d: str, freq: str = "W") -> DataFrame:
    """Weekly covariates."""
    w = resample(signal_days(spark, d), freq, ["l_discount", "l_tax", "l_quantity"], SERIES)
    return w.select("series_id", "date", F.col("l_discount").alias("u10"), F.col("l_tax").alias("v10"), F.col("l_quantity").alias("blh"))


def facilities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.when(F.col("s_acctbal") < 0, "retired").otherwise("operating")
    return table(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.lit(118.2) + 0.03 * F.pmod(k, F.lit(10))).alias("longitude"), (F.lit(39.4) + 0.03 * F.pmod(F.floor(k / 10), F.lit(10))).alias("latitude"), status.alias("status"))


def overpasses(spark: SparkSession, d: str) -> DataFrame:
    """One 8 x 8 grid a day, with a quality and a cloud fraction for each cell."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    iy, ix = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    return e.select(
        F.date_add(F.lit("2020-01-05").cast("date"), F.col("vec_id").cast("int")).alias("time"), iy.alias("iy"), ix.alias("ix"), (F.lit(40.1) - 0.15 * iy).alias("lat"), (F.lit(117.9) + 0.15 * ix).alias("lon"),
        F.col("v").cast("double").alias("raw"), (1 - (F.col("vec_id") + F.col("i")) % 10 / 20.0).alias("qa"), ((F.col("vec_id") * 7 + F.col("i")) % 100 / 100.0).alias("cloud"),
    )


def masked(spark: SparkSession, d: str, threshold: float = 0.75) -> DataFrame:
    from tephra.functions.cleaning import quality_mask

    return overpasses(spark, d).withColumn("value", quality_mask(F.col("raw"), F.col("qa"), threshold))


def cube(spark: SparkSession, d: str, freq: str = "W") -> DataFrame:
    from tephra.operators.grid import composite

    return composite(masked(spark, d), freq)


def prices(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, date, close): the mean price of a day by return flag, and of all lines as ALL."""
    days = signal_days(spark, d)
    own = days.groupBy(F.col("l_returnflag").alias("symbol"), "date").agg(F.avg("value").alias("close"))
    return own.unionByName(days.groupBy(F.lit("ALL").alias("symbol"), "date").agg(F.avg("value").alias("close")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in their order."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- the same as SQL

SIGNAL_DAYS = "sd AS (SELECT l_shipdate::DATE AS date, l_extendedprice AS value, l_discount, l_tax, l_quantity, l_returnflag, l_partkey FROM lineitem)"
TARGET_DAYS = "td AS (SELECT o_orderdate::DATE AS date, o_totalprice AS value FROM orders)"
KEY = {"W": "(date_trunc('week', date) + INTERVAL 6 DAY)::DATE", "ME": "last_day(date)", "D": "date"}


def regular(name: str, source: str, values: dict[str, str], freq: str = "W") -> str:
    """CTEs of a resampled series with its gaps. values: name -> aggregate."""
    aggs = ", ".join(f"{v} AS {k}" for k, v in values.items())
    step = {"W": "generate_series(min(date), max(date), INTERVAL 7 DAY)", "ME": "generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)", "D": "generate_series(min(date), max(date), INTERVAL 1 DAY)"}[freq]
    label = "last_day(t::DATE)" if freq == "ME" else "t::DATE"
    return f"{name}_a AS (SELECT {KEY[freq]} AS date, {aggs} FROM {source} GROUP BY 1), {name}_s AS (SELECT {label} AS date FROM (SELECT unnest({step}) AS t FROM {name}_a)), {name} AS (SELECT s.date, {', '.join(f'a.{k}' for k in values)} FROM {name}_s s LEFT JOIN {name}_a a USING (date))"


def pair_sql(freq: str = "W") -> str:
    return f"{SIGNAL_DAYS}, {TARGET_DAYS}, {regular('sg', 'sd', {'value': 'avg(value)'}, freq)}, {regular('tg', 'td', {'value': 'avg(value)'}, freq)}, pr AS (SELECT date, sg.value AS x, tg.value AS y FROM sg JOIN tg USING (date) WHERE sg.value IS NOT NULL AND tg.value IS NOT NULL)"


def weather_sql(freq: str = "W") -> str:
    return regular("we", "sd", {"u10": "avg(l_discount)", "v10": "avg(l_tax)", "blh": "avg(l_quantity)"}, freq)


FACILITIES = "fac AS (SELECT s_name AS name, 118.2::DOUBLE + 0.03::DOUBLE * (s_suppkey % 10) AS longitude, 39.4::DOUBLE + 0.03::DOUBLE * ((s_suppkey // 10) % 10) AS latitude, CASE WHEN s_acctbal < 0 THEN 'retired' ELSE 'operating' END AS status FROM supplier), act AS (SELECT * FROM fac WHERE status IN ('operating', 'operating pre-retirement'))"
OVERPASSES = """op AS (SELECT date '2020-01-05' + vec_id::INT AS time, i // 8 AS iy, i % 8 AS ix, 40.1::DOUBLE - 0.15::DOUBLE * (i // 8) AS lat, 117.9::DOUBLE + 0.15::DOUBLE * (i % 8) AS lon, v::DOUBLE AS raw, 1 - ((vec_id + i) % 10) / 20.0::DOUBLE AS qa, ((vec_id * 7 + i) % 100) / 100.0::DOUBLE AS cloud
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)), ms AS (SELECT *, CASE WHEN qa >= 0.75 THEN raw END AS value FROM op)"""


def cube_sql(freq: str = "W") -> str:
    key = KEY[freq].replace("date,", "time,").replace(", date)", ", time)").replace("(date)", "(time)")
    if freq == "D":
        key = "time"
    return f"""{OVERPASSES}, tot AS (SELECT {key} AS period, count(DISTINCT time) AS total FROM ms GROUP BY 1),
cp AS (SELECT {key} AS period, iy, ix, lat, lon, avg(value) AS value, count(value) AS valid FROM ms GROUP BY ALL),
cc AS (SELECT *, valid / total AS coverage, avg((valid >= 1)::INT) OVER (PARTITION BY period) AS period_coverage FROM cp JOIN tot USING (period)),
cube AS (SELECT period, iy, ix, lat, lon, CASE WHEN valid >= 1 AND period_coverage >= 0.25 THEN value END AS value, coverage, period_coverage FROM cc)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2)"
    return f"(2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0, greatest(0.0, {h})))))"


def masks_sql(radius: float = 15, inner: float = 25, outer: float = 60) -> str:
    """fp and ring over the cells of op."""
    return f"""{FACILITIES}, cells AS (SELECT DISTINCT iy, ix, lat, lon FROM op),
fp AS (SELECT * FROM cells c WHERE EXISTS (SELECT 1 FROM act a WHERE {haversine_sql('c.lat', 'c.lon', 'a.latitude', 'a.longitude')} <= {radius})),
ring AS (SELECT c.* FROM cells c, (SELECT avg(longitude) AS clon, avg(latitude) AS clat FROM act) m WHERE {haversine_sql('c.lat', 'c.lon', 'm.clat', 'm.clon')} BETWEEN {inner} AND {outer}
  AND c.lon BETWEEN 117.964 - 0.25 AND 119.047 + 0.25 AND c.lat BETWEEN 38.954 - 0.25 AND 40.210 + 0.25 AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.iy = c.iy AND fp.ix = c.ix))"""


def effective_n_sql(first: str, nw: str, r: str | None = None) -> str:
    """n and its effective sizes of the weekly pair, and its correlation under the name r."""
    more = f", round((SELECT corr(x, y) FROM pr), 4) AS {r}" if r else ""
    return f"""WITH {pair_sql()}, z AS (SELECT date, x - avg(x) OVER () AS a, y - avg(y) OVER () AS b FROM pr), l AS (SELECT k, a, b, lag(a, k) OVER (PARTITION BY k ORDER BY date) AS la, lag(b, k) OVER (PARTITION BY k ORDER BY date) AS lb FROM z, (SELECT unnest(range(1, 32))::INT AS k)),
p AS (SELECT k, (sum(a * la) / sum(a * a)) * (sum(b * lb) / sum(b * b)) AS ab FROM l GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n, greatest(1, least(floor(4 * pow(count(*) / 100, 2 / 9.0::DOUBLE)), count(*) - 2)) AS w FROM pr),
s AS (SELECT n, max(ab) FILTER (k = 1) AS ab1, 1 + 2 * sum(CASE WHEN k <= w THEN (1 - k / (w + 1)) * ab ELSE 0 END) AS spread FROM p, n GROUP BY n)
SELECT n::BIGINT AS n{more}, round(least(greatest(n * (1 - ab1) / (1 + ab1), 2), n), 4) AS {first}, round(least(greatest(n / spread, 2), n), 4) AS {nw} FROM s"""
