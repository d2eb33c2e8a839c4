"""Commands over files: each reads Parquet or CSV, runs a pipeline and writes its result."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import functions as F

from tephra.errors import EngineError
from tephra.plans import pipelines as pl
from tephra.session import session
from tephra.sources import files, scans, seams, sinks


def _load(name: str):
    """A callable named module:attribute, which stands for a network."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def fetch(spark, a):
    report = seams.acquire(spark, _load(a.fetcher)(spark), a.out, a.start, a.stop, a.qa)
    return {"fetched": len(report.fetched), "skipped": len(report.skipped), "errors": report.errors}


def ingest_benchmark(spark, a):
    path = seams.snapshot(spark, _load(a.fetcher), a.snapshot) if a.fetcher else a.snapshot
    long = scans.wide_snapshot(scans.snapshot_lines(spark, path), a.column, a.aux or [])
    wide = long.groupBy("date").pivot("name", [a.column, *(a.aux or [])]).agg(F.max("value"))
    sinks.write_target(wide, a.out, a.column, path, a.date)
    return {"rows": long.count()}


def ingest_meteo(spark, a):
    own = [scans.canonical_grid(spark.read.parquet(p)) for p in a.parts]
    scans.dedup_times(own, a.start, a.stop).write.mode("overwrite").parquet(a.out)
    return {"parts": len(own)}


def ingest_market(spark, a):
    got, lacking = seams.closes(lambda names: spark.read.option("header", True).option("inferSchema", True).csv(a.prices), a.symbols)
    got.write.mode("overwrite").parquet(a.out)
    return {"missing": lacking}


def grid(spark, a):
    cube, mean = pl.build_cube(spark.read.parquet(a.observations), a.freq)
    sinks.write_cube(cube, f"{a.out}/cube")
    mean.write.mode("overwrite").parquet(f"{a.out}/aoi_mean")
    return {"cube": f"{a.out}/cube"}


def attribute(spark, a):
    pl.footprint(spark.read.parquet(a.cube), scans.facilities(spark, a.facilities), (a.radius, *pl.RADII[1:]), a.mode).write.mode("overwrite").parquet(a.out)
    return {"signal": a.out}


def index(spark, a):
    meteo = None if a.no_meteo or not a.meteo else spark.read.parquet(a.meteo)
    out = pl.activity_index(spark.read.parquet(a.signal), meteo, None, a.freq, deseason=a.deseason, anchor=a.anchor)
    sinks.write_index(out, a.out, pl.provenance(a.deseason, a.anchor, *(("linear", [c for c in meteo.columns if c != "date"]) if meteo is not None else ())))
    return {"index": a.out}


def validate(spark, a):
    payload = pl.validate(spark.read.parquet(a.index), spark.read.parquet(a.target), a.freq, max_lag=a.max_lag)
    text = pl.validation_summary(payload)
    sinks.write_report(spark, a.out, payload, text)
    return {"conclusion": payload["conclusion"]}


def _residual(spark, path):
    r = spark.read.parquet(path)
    return r if "series_id" in r.columns else r.withColumn("series_id", F.lit("signal"))


def detect_events(spark, a):
    from tephra.operators.events import detect

    r = _residual(spark, a.residual)
    detect(r, "residual_activity", ["series_id"], method=a.detector, z_thresh=a.z, coverage="valid_coverage" if "valid_coverage" in r.columns else None).write.mode("overwrite").parquet(a.out)
    return {"events": spark.read.parquet(a.out).count()}


def catalyst(spark, a):
    prices = spark.read.parquet(a.prices) if a.prices else None
    calendar = scans.curtailment_calendar(spark, a.calendar) if a.calendar else None
    out = pl.catalyst(_residual(spark, a.residual), _residual(spark, a.target), spark.read.parquet(a.meteo) if a.meteo else None, calendar, prices, a.freq, detector=a.detector)
    for name in ("events", "matched", "study", "per_event"):
        if name in out:
            out[name].write.mode("overwrite").parquet(f"{a.out}/{name}")
    row = out["summary"].first().asDict()
    sinks.write_report(spark, a.out, row, "\n".join(f"{k}: {v}" for k, v in row.items()) + "\n")
    return row


def scale_sweep(spark, a):
    out = pl.scale_sweep(spark.read.parquet(a.cube), spark.read.parquet(a.target), scans.facilities(spark, a.facilities), seed=a.seed, draws_boot=a.draws, draws_perm=a.draws)
    sinks.write_table(out, a.out)
    return {"table": a.out}


def verify(spark, a):
    rows = scans.clear_days(scans.manifest(spark, a.manifest), a.max_cloud, a.min_coverage, a.n)
    return {"days": [r["id"] for r in rows.collect()], "versions_differ": seams.version_discontinuity(scans.manifest(spark, a.manifest)).first()[0]}


COMMANDS = {
    "fetch": (fetch, [("--fetcher", {"required": True}), ("--out", {"required": True}), ("--start", {"default": "2019-01-01"}), ("--stop", {"required": True}), ("--qa", {"type": float, "default": 0.75})]),
    "ingest-benchmark": (ingest_benchmark, [("--snapshot", {"required": True}), ("--column", {"required": True}), ("--aux", {"nargs": "*"}), ("--date", {"required": True}), ("--fetcher", {}), ("--out", {"required": True})]),
    "ingest-era5": (ingest_meteo, [("--parts", {"nargs": "+", "required": True}), ("--start", {"required": True}), ("--stop", {"required": True}), ("--out", {"required": True})]),
    "ingest-market": (ingest_market, [("--prices", {"required": True}), ("--symbols", {"nargs": "+", "required": True}), ("--out", {"required": True})]),
    "grid": (grid, [("--observations", {"required": True}), ("--freq", {"default": "W"}), ("--out", {"required": True})]),
    "attribute": (attribute, [("--cube", {"required": True}), ("--facilities", {"required": True}), ("--radius", {"type": float, "default": 15.0}), ("--mode", {"default": "subtract"}), ("--out", {"required": True})]),
    "index": (index, [("--signal", {"required": True}), ("--meteo", {}), ("--no-meteo", {"action": "store_true"}), ("--deseason", {"default": "yoy"}), ("--anchor", {"default": "zscore"}), ("--freq", {"default": "W"}), ("--out", {"required": True})]),
    "validate": (validate, [("--index", {"required": True}), ("--target", {"required": True}), ("--freq", {"default": "W"}), ("--max-lag", {"type": int, "default": 8}), ("--out", {"required": True})]),
    "detect-events": (detect_events, [("--residual", {"required": True}), ("--detector", {"default": "zscore"}), ("--z", {"type": float, "default": 2.0}), ("--out", {"required": True})]),
    "catalyst": (catalyst, [("--residual", {"required": True}), ("--target", {"required": True}), ("--meteo", {}), ("--calendar", {}), ("--prices", {}), ("--detector", {"default": "zscore"}), ("--freq", {"default": "W"}), ("--out", {"required": True})]),
    "scale-sweep": (scale_sweep, [("--cube", {"required": True}), ("--target", {"required": True}), ("--facilities", {"required": True}), ("--seed", {"type": int, "default": 20260614}), ("--draws", {"type": int, "default": 5000}), ("--out", {"required": True})]),
    "verify-no2": (verify, [("--manifest", {"required": True}), ("--max-cloud", {"type": float, "default": 0.3}), ("--min-coverage", {"type": float, "default": 0.5}), ("-n", {"type": int, "default": 3})]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tephra", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        own = sub.add_parser(name)
        for flag, how in options:
            own.add_argument(flag, **how)
        own.set_defaults(run=f)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    try:
        for name in ("cube", "signal", "index", "target", "residual", "observations"):
            if (path := getattr(args, name, None)) and not files.exists(spark, path):
                raise EngineError(f"{path} is missing; run the step before it first")
        print(json.dumps(args.run(spark, args), default=str))
        return 0
    except (EngineError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
