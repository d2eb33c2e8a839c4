"""Queries of scans, cleaning and resumable acquisition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.operators import grid as g
from tephra.operators import index as ix
from tephra.plans import frames as fr
from tephra.plans.frames import rounded
from tephra.registry import query
from tephra.sources import figures, files, scans, seams, sinks
from tephra.sources.scratch import scratch


@query("S1, F7, T10", """WITH o AS (SELECT o_orderdate::DATE AS date, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END AS price FROM orders)
SELECT date, 'price' AS name, nullif(arg_max(price, o_orderkey), 0.0) AS value FROM o GROUP BY 1""")  # fmt: skip
def wide_snapshot(spark, d):
    """Orders as lines of a snapshot: a line to skip, a header, metadata, then dated rows with padded numbers."""
    o = fr.table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit("0.00")).otherwise(F.concat(F.lit('"'), F.col("o_totalprice").cast("string"), F.lit(' "')))
    rows = o.select((F.col("o_orderkey") + 10).alias("line_no"), F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), price).alias("value"))
    head = spark.sql("select * from values (0L, '#ERROR!'), (1L, 'Name,price'), (2L, 'Unit,money'), (3L, 'Source,orders'), (4L, 'not a date,1.0') v(line_no, value)")
    return scans.wide_snapshot(head.unionByName(rows), "price", ["absent"])


@query("F7", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount FROM lineitem")
def zero_is_missing(spark, d):
    from tephra.functions.cleaning import number

    li = fr.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", number(F.concat(F.lit(" "), F.col("l_discount").cast("string"), F.lit(" "))).alias("discount"))


@query("S12, S13, O4", f"""WITH {fr.OVERPASSES}, p AS (SELECT *, 0 AS part FROM op WHERE time < date '2020-06-01' UNION ALL SELECT * REPLACE (raw + 1 AS raw), 1 FROM op WHERE time >= date '2020-05-20')
SELECT time, iy::INT AS iy, ix::INT AS ix, round(arg_min(raw, part), 6) AS raw FROM p WHERE time BETWEEN date '2020-01-10' AND date '2020-12-31' GROUP BY 1, 2, 3""")  # fmt: skip
def reanalysis_parts(spark, d):
    grid = fr.overpasses(spark, d).withColumnsRenamed({"lat": "latitude", "lon": "longitude", "time": "valid_time"}).withColumn("number", F.lit(0))
    own = scans.canonical_grid(grid)
    parts = [own.where("time < '2020-06-01'"), own.where("time >= '2020-05-20'").withColumn("raw", F.col("raw") + 1)]
    return rounded(scans.dedup_times(parts, "2020-01-10", "2020-12-31").select("time", "iy", "ix", "raw"))


@query("S14, A9, J6", f"WITH {fr.SIGNAL_DAYS} SELECT date, l_returnflag AS symbol, round(avg(value), 6) AS close FROM sd WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2")
def price_melt(spark, d):
    wide = fr.signal_days(spark, d).groupBy("date").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("value"))
    return rounded(scans.prices(wide, ["A", "R", "ZZZ"])[0])


@query("O7", "SELECT row_number() OVER (ORDER BY min(o_orderkey)) AS i, o_orderpriority AS symbol FROM orders GROUP BY 2")
def distinct_symbols(spark, d):
    return scans.distinct_symbols(fr.table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_orderpriority").alias("symbol"))).select(F.col("i").cast("long").alias("i"), "symbol")


@query("Q1, J6", f"WITH {fr.OVERPASSES} SELECT strftime(time, '%Y-%m-%dT000000') AS id, count(*) AS n FROM op WHERE time >= date '2020-02-15' GROUP BY 1")
def resumable_new(spark, d):
    """Observations that a manifest, which knows those before a day, doesn't know yet."""
    op = fr.overpasses(spark, d)
    known = op.where("time < '2020-02-15'").select(F.date_format("time", "yyyy-MM-dd'T'HHmmss").alias("id")).distinct()
    return seams.new_only(op, known).groupBy("id").agg(F.count("*").alias("n"))


@query("F16, F19", f"WITH {fr.OVERPASSES} SELECT count(DISTINCT CASE WHEN time + 760 < date '2022-07-01' THEN 'v1.x' ELSE 'v2.x' END) > 1 AS discontinuity FROM op")
def version_discontinuity(spark, d):
    obs = fr.masked(spark, d).withColumn("time", F.date_add("time", 760).cast("timestamp"))
    return seams.version_discontinuity(seams.overpass_stats(obs))


@query("T5, S5", f"WITH {fr.OVERPASSES} SELECT time, count(DISTINCT iy) AS ny, count(DISTINCT ix) AS nx FROM op GROUP BY 1")
def uniform_grid(spark, d):
    obs = fr.overpasses(spark, d)
    g.uniform_shape(obs)
    return obs.groupBy("time").agg(F.count_distinct("iy").alias("ny"), F.count_distinct("ix").alias("nx"))


@query("S4", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def parquet_scan(spark, d):
    return fr.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")


# ---------------------------------------------------------------- written and read again


@query("S2, F1", f"WITH {fr.FACILITIES} SELECT name, status, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM act")
def facilities_scan(spark, d):
    path = scratch(spark, "facilities")
    sinks.write_table(fr.facilities(spark, d), path)
    return rounded(scans.facilities(spark, path))


_INTERVALS = "(VALUES (date '1996-02-04', date '1996-03-03', 'down', 'restart'), (date '1997-08-10', date '1997-09-07', 'up', NULL)) v(a, b, direction, cause)"


@query("S3", f"SELECT a AS start, b AS \"end\", direction, coalesce(cause, 'curtailment') AS cause FROM {_INTERVALS}")
def calendar_scan(spark, d):
    """A stored calendar and an absent one."""
    path = scratch(spark, "calendar")
    sinks.write_table(spark.sql("select * from values (date '1996-02-04', date '1996-03-03', 'down', 'restart'), (date '1997-08-10', date '1997-09-07', 'up', null) v(`start`, `end`, direction, cause)"), path)
    return scans.curtailment_calendar(spark, path).unionByName(scans.curtailment_calendar(spark, None))


@query("K3, S6", f"WITH {fr.cube_sql()} SELECT period, iy::INT AS iy, ix::INT AS ix, round(value, 6) AS value, round(coverage, 6) AS coverage FROM cube WHERE period BETWEEN date '2020-03-01' AND date '2020-12-31'")
def cube_store(spark, d):
    """A written cube, of which a span of one year is read."""
    path = scratch(spark, "cube")
    sinks.write_cube(fr.cube(spark, d), path)
    return rounded(scans.cube(spark, path, "2020-03-01", "2020-12-31").select("period", "iy", "ix", "value", "coverage"))


_WIDE = "wd AS (SELECT o_orderdate::DATE AS date, avg(o_totalprice) AS price, CASE WHEN count(*) % 2 = 0 THEN count(*)::DOUBLE END AS n FROM orders GROUP BY 1)"


@query("K1, A9", f"WITH {_WIDE} SELECT date, 'price' AS series, round(price, 4) AS value, 'made' AS source, date '2024-02-03' AS snapshot_date FROM wd UNION ALL SELECT date, 'n', n, 'made', date '2024-02-03' FROM wd WHERE n IS NOT NULL")
def target_store(spark, d):
    """A target as tidy rows and its companion as long rows beside it."""
    path, n = scratch(spark, "target"), F.count("*")
    wide = fr.target_days(spark, d).groupBy("date").agg(F.avg("value").alias("price"), F.when(n % 2 == 0, n.cast("double")).alias("n"))
    sinks.write_target(wide, path, "price", "made", "2024-02-03")
    main = spark.read.parquet(f"{path}/target").withColumn("series", F.lit("price"))
    return rounded(main.unionByName(spark.read.parquet(f"{path}/aux")).select("date", "series", "value", "source", "snapshot_date"), 4)


@query("K2", f"WITH {fr.OVERPASSES} SELECT year(time)::INT AS year, 'v2' AS processor_version, count(*) AS n, count(value) AS valid, round(sum(value), 6) AS total FROM ms GROUP BY 1")
def overpass_store(spark, d):
    path = scratch(spark, "overpasses")
    sinks.write_overpasses(fr.masked(spark, d), path, "v2")
    return rounded(spark.read.parquet(path).groupBy("year", "processor_version").agg(F.count("*").alias("n"), F.count("value").alias("valid"), F.sum("value").alias("total")))


@query("K4", f"WITH {fr.SIGNAL_DAYS}, {fr.regular('sg', 'sd', {'value': 'avg(value)'})} SELECT date, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS index_value, 'yoy' AS deseason, 0.43::DOUBLE AS cap FROM sg")
def index_store(spark, d):
    """An index with what it was made with, read back from the stored schema."""
    from tephra.plans.pipelines import provenance

    path = scratch(spark, "index")
    sinks.write_index(ix.build_index(fr.signal(spark, d), "value", fr.SERIES), path, provenance("yoy", "zscore"))
    got = spark.read.parquet(path)
    notes = sinks.provenance(got, "index_value")
    return rounded(got.select("date", "index_value", F.lit(notes["deseason_method"]).alias("deseason"), F.lit(notes["attributable_cap"][1]).alias("cap")))


@query("K5", "SELECT count(*) AS n, round(max(o_totalprice), 2) AS most, 'n: ' || count(*) AS text FROM orders")
def report_store(spark, d):
    path = scratch(spark, "report")
    row = fr.table(spark, d, "orders").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("most")).first().asDict()
    sinks.write_report(spark, path, row, f"n: {row['n']}\n")
    got = spark.read.schema("n long, most double").option("multiLine", True).json(f"{path}/results.json")
    return got.withColumn("text", F.lit(files.read_text(spark, f"{path}/summary.txt").strip()))


@query("K6", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def table_store(spark, d):
    path = scratch(spark, "table")
    sinks.write_table(fr.table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), path)
    return spark.read.schema("p_partkey long, p_brand string, p_size int, p_retailprice double").option("header", True).csv(path)


@query("S7, K7", f"WITH {fr.OVERPASSES} SELECT strftime(time, '%Y-%m-%dT000000') AS id, round(count(value) / count(*), 6) AS valid_coverage, round(avg(value), 6) AS no2_mean, round(avg(cloud), 6) AS cloud_mean, 0.75::DOUBLE AS qa_threshold FROM ms GROUP BY time")
def manifest_store(spark, d):
    """A manifest that wasn't there, filled, saved and scanned."""
    path = scratch(spark, "manifest.json")
    state = files.load_manifest(spark, path)
    for s in seams.overpass_stats(fr.masked(spark, d).withColumn("time", F.col("time").cast("timestamp"))).collect():  # a row an overpass
        state["overpasses"][s["id"]] = {c: s[c] for c in ("valid_coverage", "no2_mean", "cloud_mean")} | {"qa_threshold": 0.75}
    files.save_manifest(spark, path, state)
    return rounded(scans.manifest(spark, path).select("id", "valid_coverage", "no2_mean", "cloud_mean", "qa_threshold"))


@query("S8, S9", "SELECT 'wind_2024-03-01.csv' AS name, 3::BIGINT AS n_lines")
def latest_snapshot(spark, d):
    """Snapshots that were fetched once each, and the latest by name."""
    top = scratch(spark, "snapshots")
    for day in ("2024-01-01", "2024-03-01", "2023-12-31"):
        for body in (f"x\nName,a\n{day},1", "Name, not written over"):
            seams.snapshot(spark, lambda body=body: body, f"{top}/wind_{day}.csv")
    path = scans.latest_snapshot(spark, top, "wind_*.csv")
    return scans.snapshot_lines(spark, path).agg(F.lit(path.rsplit("/", 1)[1]).alias("name"), F.count("*").alias("n_lines"))


@query("S10", f"WITH {fr.OVERPASSES} SELECT time, iy::INT AS iy, ix::INT AS ix, round(raw, 6) AS no2, round(qa, 6) AS qa, NULL::DOUBLE AS cloud FROM op")
def band_merge(spark, d):
    """Bands that come one by one, of which an optional one can't be had."""
    op = fr.overpasses(spark, d)
    have = {"COLUMN": "raw", "QUALITY": "qa"}
    return rounded(seams.merged_bands(lambda band: op.withColumn("value", F.col(have[band])), {"no2": "COLUMN", "qa": "QUALITY", "cloud": "CLOUD"}))


@query("K8", f"WITH {fr.OVERPASSES}, {fr.FACILITIES} SELECT 'field' AS layer, round(lon, 6) AS lon, round(lat, 6) AS lat, round(value, 6) AS value FROM ms WHERE time = date '2020-02-10' UNION ALL SELECT 'facility', round(longitude, 6), round(latitude, 6), NULL FROM act")
def map_of_a_day(spark, d):
    """What the map of one overpass shows."""
    from tephra.config import ACTIVE_STATUS

    day = fr.masked(spark, d).where("time = date '2020-02-10'")
    return rounded(figures.map_layers(day, g.active(fr.facilities(spark, d), ACTIVE_STATUS)))
