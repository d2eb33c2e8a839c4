"""Queries of gridded observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.config import ENVELOPE
from tephra.functions import geo
from tephra.functions.calendar import period_key
from tephra.operators import grid as g
from tephra.operators.series import resample
from tephra.plans import frames as fr
from tephra.plans.frames import rounded
from tephra.registry import query

_TIGHT = ENVELOPE.buffered(0.10)


def _active(spark, d):
    return g.active(fr.facilities(spark, d), ("operating", "operating pre-retirement"))


def _cells(spark, d):
    return g.cells(fr.overpasses(spark, d))


def _masks(spark, d, radius=15.0, inner=25.0, outer=60.0):
    cells, fac = _cells(spark, d), _active(spark, d)
    fp = g.radius_mask(cells, fac, radius)
    return fp, g.ring_mask(cells, fp, fac, inner, outer)


@query("F2, G15, G16, T12, Q1", f"WITH {fr.OVERPASSES} SELECT time, round(count(value) / count(*), 6) AS valid_coverage, round(avg(value), 6) AS no2_mean, round(avg(cloud), 6) AS cloud_mean FROM ms GROUP BY 1")
def overpass_statistics(spark, d):
    return rounded(fr.masked(spark, d).groupBy("time").agg((F.count("value") / F.count("*")).alias("valid_coverage"), F.avg("value").alias("no2_mean"), F.avg("cloud").alias("cloud_mean")))


@query("G9, F9, F10, S5, G18", f"WITH {fr.cube_sql()} SELECT period, iy::INT AS iy, ix::INT AS ix, round(value, 6) AS value, round(coverage, 6) AS coverage, round(period_coverage, 6) AS period_coverage FROM cube")
def composite_week(spark, d):
    return rounded(fr.cube(spark, d).drop("lat", "lon"))


@query("G10, A1", f"WITH {fr.cube_sql()} SELECT period AS date, round(avg(value), 6) AS no2_attributed, round(avg(coverage), 6) AS valid_coverage, 'naive_aoi_mean_pre_attribution' AS kind FROM cube GROUP BY 1 HAVING avg(value) IS NOT NULL")
def aoi_mean(spark, d):
    return rounded(g.aoi_mean(fr.cube(spark, d)))


@query("F3, F4, F5, G19", f"WITH {fr.OVERPASSES} SELECT DISTINCT iy::INT AS iy, ix::INT AS ix FROM op WHERE lon BETWEEN {_TIGHT.min_lon} AND {_TIGHT.max_lon} AND lat BETWEEN {_TIGHT.min_lat} AND {_TIGHT.max_lat}")
def clip_tight(spark, d):
    return g.clip(_cells(spark, d), _TIGHT).select("iy", "ix")


@query("F1, F6", f"WITH {fr.FACILITIES} SELECT round(min(longitude), 6) AS min_lon, round(min(latitude), 6) AS min_lat, round(max(longitude), 6) AS max_lon, round(max(latitude), 6) AS max_lat FROM act")
def facility_envelope(spark, d):
    return rounded(g.envelope(_active(spark, d)))


@query("G1, J10", f"WITH {fr.OVERPASSES}, {fr.FACILITIES}, cells AS (SELECT DISTINCT iy, ix, lat, lon FROM op) SELECT iy::INT AS iy, ix::INT AS ix, round({fr.haversine_sql('lat', 'lon', '39.55', '118.35')}, 6) AS km FROM cells")
def distances(spark, d):
    return rounded(_cells(spark, d).select("iy", "ix", geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(39.55), F.lit(118.35)).alias("km")))


@query("G2, G3, G4, J5, J6, F1, Q3", f"WITH {fr.OVERPASSES}, {fr.masks_sql()} SELECT iy::INT AS iy, ix::INT AS ix FROM fp")
def footprint_mask(spark, d):
    return _masks(spark, d)[0].select("iy", "ix")


@query("G5, J6", f"WITH {fr.OVERPASSES}, {fr.masks_sql()} SELECT iy::INT AS iy, ix::INT AS ix FROM ring")
def background_ring(spark, d):
    return _masks(spark, d)[1].select("iy", "ix")


_MEANS = """f AS (SELECT period, avg(value) AS v, avg(coverage) AS c FROM cube JOIN fp USING (iy, ix) GROUP BY 1), b AS (SELECT period, avg(value) AS v FROM cube JOIN ring USING (iy, ix) GROUP BY 1)"""


@query("G6, G7, G8", f"WITH {fr.cube_sql()}, {fr.masks_sql()}, {_MEANS} SELECT period AS date, round(f.v, 6) AS no2_footprint, round(b.v, 6) AS no2_bg, round(f.v - b.v, 6) AS no2_corrected, round(f.c, 6) AS valid_coverage FROM f JOIN b USING (period)")
def footprint_subtract(spark, d):
    return rounded(g.footprint_signal(fr.cube(spark, d), *_masks(spark, d)))


@query("G7", f"WITH {fr.cube_sql()}, {fr.masks_sql()}, {_MEANS} SELECT period AS date, round(f.v, 6) AS no2_footprint, round(b.v, 6) AS no2_bg, round(f.v / nullif(b.v, 0), 3) AS no2_corrected, round(f.c, 6) AS valid_coverage FROM f JOIN b USING (period)")
def footprint_normalise(spark, d):
    s = g.footprint_signal(fr.cube(spark, d), *_masks(spark, d), mode="normalise")
    return rounded(s.withColumn("no2_corrected", F.round("no2_corrected", 3)))


@query("G11", f"WITH {fr.OVERPASSES}, x AS (SELECT DISTINCT ix, lon FROM op), s AS (SELECT abs(lon - lag(lon) OVER (ORDER BY ix)) AS step FROM x) SELECT round(median(step), 6) AS spacing FROM s")
def native_spacing(spark, d):
    return rounded(g.spacing(fr.overpasses(spark, d), "lon", "ix"))


@query("G12", f"WITH {fr.cube_sql()} SELECT period, (iy // 3)::INT AS iy, (ix // 3)::INT AS ix, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(value), 6) AS value, round(avg(coverage), 6) AS coverage FROM cube WHERE iy < 6 AND ix < 6 GROUP BY 1, 2, 3")
def coarsen(spark, d):
    return rounded(g.coarsen(fr.cube(spark, d), 3, 3))


_SOURCE = "src AS (SELECT DISTINCT time, iy // 2 AS iy, ix // 2 AS ix, 40.03::DOUBLE - 0.31::DOUBLE * (iy // 2) AS lat, 117.98::DOUBLE + 0.29::DOUBLE * (ix // 2) AS lon, avg(raw) OVER (PARTITION BY time, iy // 2, ix // 2) AS blh FROM op)"


@query("G13, J9", f"""WITH {fr.OVERPASSES}, {_SOURCE}, t AS (SELECT DISTINCT iy, ix, lat, lon FROM op),
y AS (SELECT t.iy, arg_min(s.iy, (abs(t.lat - s.lat), s.iy)) AS sy FROM (SELECT DISTINCT iy, lat FROM t) t, (SELECT DISTINCT iy, lat FROM src) s GROUP BY 1), x AS (SELECT t.ix, arg_min(s.ix, (abs(t.lon - s.lon), s.ix)) AS sx FROM (SELECT DISTINCT ix, lon FROM t) t, (SELECT DISTINCT ix, lon FROM src) s GROUP BY 1)
SELECT time, y.iy::INT AS iy, x.ix::INT AS ix, round(blh, 6) AS blh FROM src JOIN y ON src.iy = y.sy JOIN x ON src.ix = x.sx""")  # fmt: skip
def regrid_nearest(spark, d):
    iy, ix = F.floor(F.col("iy") / 2).cast("int"), F.floor(F.col("ix") / 2).cast("int")
    src = fr.overpasses(spark, d).groupBy("time", iy.alias("iy"), ix.alias("ix")).agg(F.avg("raw").alias("blh"))
    src = src.withColumn("lat", F.lit(40.03) - 0.31 * F.col("iy")).withColumn("lon", F.lit(117.98) + 0.29 * F.col("ix"))
    return rounded(g.regrid_nearest(src, fr.overpasses(spark, d), ["blh"]).select("time", "iy", "ix", "blh"))


@query("G14, M24", f"""WITH {fr.OVERPASSES}, {fr.masks_sql()}, m AS (SELECT op.time, avg(raw) AS u10, avg(qa) AS v10, avg(cloud) AS blh FROM op JOIN fp USING (iy, ix) GROUP BY 1)
SELECT (date_trunc('week', time) + INTERVAL 6 DAY)::DATE AS date, round(avg(u10), 6) AS u10, round(avg(v10), 6) AS v10, round(avg(blh), 6) AS blh, round(sqrt(pow(avg(u10), 2) + pow(avg(v10), 2)), 6) AS wind_speed FROM m GROUP BY 1""")  # fmt: skip
def meteo_footprint(spark, d):
    fp, _ = _masks(spark, d)
    daily = fr.overpasses(spark, d).join(fp.select("iy", "ix"), ["iy", "ix"], "left_semi").groupBy(F.col("time").alias("date")).agg(F.avg("raw").alias("u10"), F.avg("qa").alias("v10"), F.avg("cloud").alias("blh"))
    return rounded(resample(daily, "W", ["u10", "v10", "blh"]).withColumn("wind_speed", F.hypot("u10", "v10")))


@query("F11", """SELECT event_id, ts::TIMESTAMP AS ts FROM events WHERE hour(ts) BETWEEN 4 AND 6 OR NOT (SELECT bool_or(hour(ts) BETWEEN 4 AND 6) FROM events)""")
def overpass_window(spark, d):
    return g.overpass_hours(fr.table(spark, d, "events"), "ts").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("F13, O2", f"WITH {fr.OVERPASSES}, s AS (SELECT strftime(time, '%Y-%m-%dT000000') AS id, count(value) / count(*) AS valid_coverage, avg(value) AS no2_mean, avg(cloud) AS cloud_mean FROM ms GROUP BY time) SELECT id, round(no2_mean, 6) AS no2_mean, round(cloud_mean, 6) AS cloud_mean, round(valid_coverage, 6) AS valid_coverage FROM s WHERE no2_mean IS NOT NULL AND (cloud_mean IS NULL OR cloud_mean <= 0.4) AND valid_coverage >= 0.5 ORDER BY s.no2_mean DESC, id LIMIT 5")
def clear_days(spark, d):
    from tephra.functions.calendar import observation_id
    from tephra.sources.scans import clear_days as pick

    stats = fr.masked(spark, d).groupBy("time").agg((F.count("value") / F.count("*")).alias("valid_coverage"), F.avg("value").alias("no2_mean"), F.avg("cloud").alias("cloud_mean"))
    return rounded(pick(stats.select(observation_id(F.col("time")).alias("id"), "no2_mean", "cloud_mean", "valid_coverage"), 0.4, 0.5, 5))


@query("M38", f"""WITH {fr.OVERPASSES}, {fr.FACILITIES}, cells AS (SELECT DISTINCT iy, ix, lat, lon FROM op)
SELECT r::DOUBLE AS radius_km, count(*) AS n_cells FROM cells c, (VALUES (5), (10), (15), (20)) t(r) WHERE EXISTS (SELECT 1 FROM act a WHERE {fr.haversine_sql('c.lat', 'c.lon', 'a.latitude', 'a.longitude')} <= r) GROUP BY 1""")  # fmt: skip
def radius_sweep(spark, d):
    cells, fac = _cells(spark, d), _active(spark, d)
    parts = [g.radius_mask(cells, fac, float(r)).agg(F.lit(float(r)).alias("radius_km"), F.count("*").alias("n_cells")) for r in (5, 10, 15, 20)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n_cells > 0")


@query("G17", f"WITH {fr.OVERPASSES}, a AS (SELECT avg(lat) AS lat FROM (SELECT DISTINCT iy, lat FROM op)) SELECT round(sqrt(pow(0.15 * 111.0, 2) + pow(0.15 * 111.0 * cos(radians(lat)), 2)), 6) AS diag_km, round(greatest(15, 1.5 * sqrt(pow(0.15 * 111.0, 2) + pow(0.15 * 111.0 * cos(radians(lat)), 2))), 6) AS radius_km FROM a")
def cell_size(spark, d):
    lat = _cells(spark, d).select("iy", "lat").distinct().agg(F.avg("lat").alias("lat"))
    diag = geo.cell_diagonal_km(F.lit(0.15), F.lit(0.15), F.col("lat"))
    return rounded(lat.select(diag.alias("diag_km"), F.greatest(F.lit(15.0), 1.5 * diag).alias("radius_km")))


@query("M34", f"""WITH {fr.cube_sql()}, {fr.masks_sql()}, cl AS (SELECT * FROM cube WHERE lon BETWEEN {_TIGHT.min_lon} AND {_TIGHT.max_lon} AND lat BETWEEN {_TIGHT.min_lat} AND {_TIGHT.max_lat}),
lo AS (SELECT min(ix) AS x0, min(iy) AS y0, max(ix) - min(ix) + 1 AS nx, max(iy) - min(iy) + 1 AS ny FROM cl),
co AS (SELECT period, (iy - y0) // 2 AS iy, (ix - x0) // 2 AS ix, avg(value) AS value FROM cl, lo WHERE iy - y0 < (ny // 2) * 2 AND ix - x0 < (nx // 2) * 2 GROUP BY ALL)
SELECT period AS date, round(avg(value), 6) AS value, 'aoi-mean-fallback' AS label FROM co GROUP BY 1""")  # fmt: skip
def scale_fallback(spark, d):
    from tephra.plans.pipelines import scale_signal

    return rounded(scale_signal(fr.cube(spark, d), _active(spark, d), 0.10, 2, 2, least_cells=99).select("date", "value", "label"))


@query("G9, F10", f"WITH {fr.cube_sql('ME')} SELECT period, count(value) AS n, round(avg(period_coverage), 6) AS period_coverage FROM cube GROUP BY 1")
def composite_month(spark, d):
    return rounded(fr.cube(spark, d, "ME").groupBy("period").agg(F.count("value").alias("n"), F.avg("period_coverage").alias("period_coverage")))


@query("T3", f"WITH {fr.OVERPASSES} SELECT {fr.KEY['W'].replace('date)', 'time)').replace(', date', ', time')} AS period, count(value) AS valid, count(*) AS total FROM ms GROUP BY 1")
def valid_counts(spark, d):
    return fr.masked(spark, d).groupBy(period_key(F.col("time"), "W").alias("period")).agg(F.count("value").alias("valid"), F.count("*").alias("total"))


@query("F12", "SELECT * FROM (VALUES (0, '04:00'), (1, '05:00'), (2, '06:00')) v(i, hour)")
def request_hours(spark, d):
    return spark.createDataFrame(list(enumerate(g.request_hours())), "i int, hour string")
