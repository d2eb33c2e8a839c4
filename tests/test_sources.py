from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tephra.errors import AcquisitionError, AuthenticationError, ColumnError, GriddingError, MarketDataError, SourceError
from tephra.sources import figures, files, scans, seams, sinks
from tephra.sources.scratch import scratch
from tephra.streaming import ingest as st

LINES = ["#ERROR!", "Name,BF rate,Other", "Unit,%,%", "Source,x,y", '2018-03-09,"70.50 ",1.0', "2018-03-16,72.10,0.00", "2018-03-16,73.10,2.0", "2018-03-23,0.00,3.0", "not a date,1,1"]


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_snapshot_scan(spark, tmp_path):
    lines = scans.snapshot_lines(spark, _file(tmp_path, "wind_2018-04-01.csv", "\r\n".join(LINES) + "\n"))
    out = {(r.date.day, r.name): r.value for r in scans.wide_snapshot(lines, "BF rate", ["Other", "Absent"]).collect()}
    assert out == {(9, "BF rate"): 70.5, (16, "BF rate"): 73.1, (23, "BF rate"): None, (9, "Other"): 1.0, (16, "Other"): 2.0, (23, "Other"): 3.0}
    with pytest.raises(ColumnError):
        scans.wide_snapshot(lines, "Absent")
    assert scans.latest_snapshot(spark, str(tmp_path), "wind_*.csv").endswith("wind_2018-04-01.csv")
    with pytest.raises(SourceError):
        scans.latest_snapshot(spark, str(tmp_path), "none_*.csv")


def test_tables(spark, tmp_path):
    path = _file(tmp_path, "f.csv", "name,latitude,longitude,technology,status\na,39.1,118.2,BF,operating\nb,39.2,118.3,BF,retired\n")
    assert [r.name for r in scans.facilities(spark, path).collect()] == ["a"]
    with pytest.raises(ColumnError):
        scans.facilities(spark, _file(tmp_path, "g.csv", "name,latitude\na,1\n"))
    cal = scans.curtailment_calendar(spark, _file(tmp_path, "c.csv", "start,end,direction\n2020-01-01,2020-02-01,down\n")).first()
    assert (cal.start, cal.cause) == (dt.date(2020, 1, 1), "curtailment")
    assert scans.curtailment_calendar(spark, None).count() == 0


def test_grid_names_and_parts(spark):
    df = spark.sql("select 1.0D as x, 2.0D as latitude, timestamp '2020-01-01' as t, double('NaN') as band, 3 as crs")
    out = scans.canonical_grid(df, {"band": "value"}).first().asDict()
    assert out["value"] is None and set(out) == {"lon", "lat", "time", "value"}
    with pytest.raises(ColumnError):
        scans.canonical_grid(df.drop("x"))


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert files.load_manifest(spark, path)["overpasses"] == {}
    entries = {"A": {"no2_mean": 3.0, "cloud_mean": 0.1, "valid_coverage": 0.9, "path": "a"}, "B": {"no2_mean": 2.0, "cloud_mean": None, "valid_coverage": 0.9}, "C": {"no2_mean": 9.0, "cloud_mean": 0.9, "valid_coverage": 0.9}, "D": {"no2_mean": None, "cloud_mean": 0.0, "valid_coverage": 0.9}}
    files.save_manifest(spark, path, {"overpasses": entries, "batches_done": ["x"], "batch_errors": {}})
    rows = scans.manifest(spark, path)
    assert rows.count() == 4 and [r.id for r in scans.clear_days(rows).collect()] == ["A", "B"]
    assert files.load_manifest(spark, path)["batches_done"] == ["x"]


def _observations(spark, start, stop):
    days = spark.sql(f"select explode(sequence(date '{start}', date_sub(date '{stop}', 1), interval 10 days)) as d")
    cells = spark.range(4).select((F.col("id") / 2).cast("int").alias("iy"), (F.col("id") % 2).cast("int").alias("ix"))
    return days.crossJoin(cells).select(F.col("d").cast("timestamp").alias("time"), "iy", "ix", F.lit(39.5).alias("lat"), F.lit(118.0).alias("lon"), F.lit(2.0).alias("value"), F.when(F.col("ix") == 0, 0.9).otherwise(0.4).alias("qa"), F.lit(0.1).alias("cloud"))


class Source:
    def __init__(self, spark, fail=()):
        self.spark, self.fail, self.calls = spark, fail, []

    def fetch(self, start, stop):
        self.calls.append(start)
        if start in self.fail:
            raise AcquisitionError("job failed")
        return _observations(self.spark, start, stop)


def test_acquire_resumes_after_errors(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = seams.acquire(spark, Source(spark, ["2020-02-01"]), folder, "2020-01-01", "2020-04-01")
    assert list(first.errors) == ["2020-02-01/2020-03-01"]
    n = spark.read.parquet(f"{folder}/observations").count()
    again = Source(spark)
    second = seams.acquire(spark, again, folder, "2020-01-01", "2020-04-01")
    assert again.calls == ["2020-02-01"] and len(second.skipped) == 2 and not second.errors
    stored = spark.read.parquet(f"{folder}/observations")
    assert stored.count() > n and stored.where("qa < 0.75 and value is not null").count() == 0
    state = files.load_manifest(spark, f"{folder}/manifest.json")
    assert all(e["valid_coverage"] == 0.5 and e["processor_version"] == "v1.x" for e in state["overpasses"].values())
    third = seams.acquire(spark, Source(spark), folder, "2020-01-01", "2020-04-01")
    assert not third.fetched and spark.read.parquet(f"{folder}/observations").count() == stored.count()


def test_snapshot_is_never_clobbered(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    with pytest.raises(SourceError):
        seams.snapshot(spark, lambda: "<html>", path)
    assert not files.exists(spark, path)
    seams.snapshot(spark, lambda: "Name,a\n", path)
    seams.snapshot(spark, lambda: "Name,b\n", path)
    assert files.read_text(spark, path) == "Name,a\n"


def test_prices_and_symbols(spark):
    wide = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0, None)], "date date, A double, B double")
    got, lacking = seams.closes(lambda s: wide, ["A", "B", "C", "A"])
    assert [(r.symbol, r.close) for r in got.collect()] == [("A", 1.0)] and lacking == ["C"]
    with pytest.raises(MarketDataError):
        seams.closes(lambda s: wide.limit(0), ["A"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 5), 1.5)], "date date, index_value double")
    sinks.write_index(df, str(tmp_path / "i"), {"anchor": "zscore", "cap": [0.3, 0.43]})
    assert sinks.provenance(spark.read.parquet(str(tmp_path / "i")), "index_value") == {"anchor": "zscore", "cap": [0.3, 0.43]}
    sinks.write_target(df.withColumn("aux", F.lit(2.0)), str(tmp_path / "t"), "index_value", "s", "2020-02-01")
    assert spark.read.parquet(str(tmp_path / "t/aux")).first().series == "aux"
    sinks.write_report(spark, str(tmp_path / "r"), {"r": 0.1}, "text")
    assert json.loads((tmp_path / "r/results.json").read_text()) == {"r": 0.1}
    cube = df.select(F.col("date").alias("period"), F.lit(0).alias("iy"), F.lit(0).alias("ix"), "index_value")
    sinks.write_cube(cube, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("year = 2020").count() == 1
    sinks.write_table(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_stream_ingest_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    obs = _observations(spark, "2020-01-01", "2020-02-01")
    obs.union(obs).write.parquet(src)
    stream = spark.readStream.schema(obs.schema).parquet(src)
    for _ in range(2):  # the second run finds nothing new
        st.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == obs.count() and out.where("value is not null").count() == obs.count() // 2
    q = st.period_means(stream).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(value * 0 + 1) from means").first()[0] > 0


def test_connection_falls_back_and_keeps_its_secret():
    def refuse(*_):
        raise ValueError("s3cret")

    assert seams.connect(lambda: "s3cret", lambda t: ("token", t), refuse) == ("token", "s3cret")
    assert seams.connect(lambda: "s3cret", refuse, lambda: "hand") == seams.connect(lambda: None, refuse, lambda: "hand") == "hand"
    for ways in ((refuse, str, str), (lambda: "s3cret", refuse, refuse), (lambda: None, refuse, refuse)):
        with pytest.raises(AuthenticationError) as e:
            seams.connect(*ways)
        assert "s3cret" not in str(e.value)


def test_bands_are_merged_and_an_optional_one_may_lack(spark):
    op = spark.createDataFrame([("t", 0, 0, 1.5), ("t", 0, 1, None), ("u", 0, 0, 2.5)], "time string, iy int, ix int, value double")

    def fetch(band):
        if band == "gone":
            raise ValueError(band)
        return op.where("time = 't'").withColumn("value", F.col("value") * 2) if band == "half" else op

    out = {(r.time, r.ix): (r.no2, r.qa, r.cloud) for r in seams.merged_bands(fetch, {"no2": "full", "qa": "half", "cloud": "gone"}).collect()}
    assert out == {("t", 0): (1.5, 3.0, None), ("t", 1): (None, None, None), ("u", 0): (2.5, None, None)}
    with pytest.raises(AcquisitionError):
        seams.merged_bands(fetch, {"no2": "gone"})


def test_pictures(spark, tmp_path):
    import struct
    import zlib

    with pytest.raises(SourceError):
        seams.picture(spark, lambda: b"", str(tmp_path / "p"))
    assert seams.picture(spark, lambda: b"image", str(tmp_path / "p")) and (tmp_path / "p").read_bytes() == b"image"
    day = spark.createDataFrame([(118.0 + 0.1 * x, 39.0 + 0.1 * y, float(x + y) if x or y else None) for x in range(4) for y in range(3)], "lon double, lat double, value double")
    fac = spark.createDataFrame([(118.31, 39.19), (150.0, 0.0)], "longitude double, latitude double")
    layers = figures.map_layers(day, fac)
    assert layers.count() == 14
    figures.write_map(layers, str(tmp_path / "m.png"), 8)
    body = (tmp_path / "m.png").read_bytes()
    width, height = struct.unpack(">II", body[16:24])
    assert body[:8] == b"\x89PNG\r\n\x1a\n" and (width, height) == (32, 24)
    size = struct.unpack(">I", body[33:37])[0]
    rows = zlib.decompress(body[41 : 41 + size])
    pixel = lambda x, y: tuple(rows[y * (1 + 3 * width) + 1 + 3 * x :][:3])
    assert pixel(0, 23) == figures.EMPTY and pixel(28, 4) == figures.MARK and pixel(24, 0) == (253, 231, 37)
    with pytest.raises(GriddingError):
        figures.draw(layers.where("layer = 'facility'"))


def test_scratch_paths_differ(spark):
    assert scratch(spark, "x") != scratch(spark, "x")
