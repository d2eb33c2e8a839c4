"""What reaches a network stands behind a function that a caller passes in."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.errors import AcquisitionError, AuthenticationError, MarketDataError, SourceError
from tephra.functions.calendar import observation_id, processor_label
from tephra.functions.cleaning import quality_mask
from tephra.operators.series import month_batches
from tephra.sources import files


T = TypeVar("T")


class Fetcher(Protocol):
    """Observations of a half-open span of dates: time, iy, ix, lat, lon, value, qa, cloud and perhaps processor_version."""

    def fetch(self, start: str, stop: str) -> DataFrame: ...


def connect(token: Callable[[], str | None], by_token: Callable[[str], T], by_hand: Callable[[], T]) -> T:
    """A connection by a token, or by hand where there is none or it isn't accepted. Messages never hold the token."""
    try:
        own = token()
    except Exception as e:
        raise AuthenticationError(f"no token could be had: {type(e).__name__}") from e
    if own:
        try:
            return by_token(own)
        except Exception:  # noqa: S110  a token that isn't accepted leaves the other way
            pass
    try:
        return by_hand()
    except Exception as e:
        raise AuthenticationError(f"neither a token nor signing in by hand was accepted: {type(e).__name__}") from e


def merged_bands(fetch: Callable[[str], DataFrame], bands: Mapping[str, str], optional: Sequence[str] = ("cloud",), keys: Sequence[str] = ("time", "iy", "ix")) -> DataFrame:
    """One frame of bands that a source gives one by one: name -> band. An optional band that can't be had is NULL.

    Bands are put under each other and aggregated by cell, so that they meet in one shuffle.
    """
    every = None
    for name, band in bands.items():
        try:
            got = fetch(band).select(*keys, F.lit(name).alias("__band"), F.col("value").cast("double").alias("__value"))
        except Exception as e:
            if name in optional:
                continue
            raise AcquisitionError(f"band {band} can't be had: {e}") from e
        every = got if every is None else every.unionByName(got)
    if every is None:
        raise AcquisitionError("no band could be had")
    return every.groupBy(*keys).agg(*[F.max(F.when(F.col("__band") == name, F.col("__value"))).alias(name) for name in bands])


def picture(spark: SparkSession, fetch: Callable[[], bytes], path: str) -> str:
    """A fetched picture of a region as a file; a failed or empty fetch leaves none."""
    try:
        body = fetch()
    except Exception as e:
        raise SourceError(f"fetch failed: {e}") from e
    if not body:
        raise SourceError("the picture is empty")
    files.write_bytes(spark, path, body)
    return path


@dataclass
class AcquireReport:
    fetched: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


def snapshot(spark: SparkSession, fetch: Callable[[], str], path: str, mark: str = "Name,") -> str:
    """A fetched text as a file that isn't overwritten; a failed fetch or an unexpected body leaves no file."""
    if files.exists(spark, path):
        return path
    try:
        body = fetch()
    except Exception as e:
        raise SourceError(f"fetch failed: {e}") from e
    if mark not in body:
        raise SourceError(f"the body lacks {mark!r}")
    files.write_text(spark, path, body)
    return path


def overpass_stats(observations: DataFrame) -> DataFrame:
    """(id, day, valid_coverage, no2_mean, cloud_mean, processor_version) of each overpass."""
    version = F.max("processor_version") if "processor_version" in observations.columns else F.lit(None).cast("string")
    cloud = F.avg("cloud") if "cloud" in observations.columns else F.lit(None).cast("double")
    own = observations.groupBy("time").agg((F.count("value") / F.count("*")).alias("valid_coverage"), F.avg("value").alias("no2_mean"), cloud.alias("cloud_mean"), version.alias("__v"))
    return own.select(observation_id(F.col("time")).alias("id"), F.to_date("time").alias("day"), "valid_coverage", "no2_mean", "cloud_mean", processor_label(F.col("__v"), F.col("time")).alias("processor_version"))


def new_only(observations: DataFrame, known: DataFrame) -> DataFrame:
    """Observations whose overpass isn't known yet; known: (id)."""
    tagged = observations.withColumn("id", observation_id(F.col("time")))
    return tagged.join(known.select("id"), "id", "left_anti")


def acquire(spark: SparkSession, fetcher: Fetcher, folder: str, first: str, last: str, qa_threshold: float = 0.75) -> AcquireReport:
    """Fetches month by month into `folder`; goes on after errors, and on a second run does what is left.

    A batch is known by both its ends, so a month that was cut short by the last day is fetched again later.
    """
    path, report = f"{folder}/manifest.json", AcquireReport()
    state = files.load_manifest(spark, path)
    span = spark.sql(f"select date '{first}' as first, date '{last}' as last")
    for batch in month_batches(span).orderBy("start").collect():  # a row a month
        start, stop = str(batch["start"]), str(batch["stop"])
        key = f"{start}/{stop}"
        if key in state["batches_done"]:
            report.skipped.append(key)
            continue
        try:
            got = fetcher.fetch(start, stop).withColumn("value", quality_mask(F.col("value"), F.col("qa"), qa_threshold))
            known = spark.createDataFrame([(i,) for i in state["overpasses"]], "id string")
            fresh = new_only(got, known).drop("id").persist()
            fresh.withColumn("year", F.year("time")).write.mode("append").partitionBy("year").parquet(f"{folder}/observations")
            for s in overpass_stats(fresh).collect():  # a row an overpass
                state["overpasses"][s["id"]] = {k: s[k] for k in ("valid_coverage", "no2_mean", "cloud_mean", "processor_version")} | {"qa_threshold": qa_threshold}
                report.fetched.append(s["id"])
            fresh.unpersist()
        except AcquisitionError as e:
            report.errors[key] = state["batch_errors"][key] = str(e)
            files.save_manifest(spark, path, state)
            continue
        state["batches_done"].append(key)
        state["batch_errors"].pop(key, None)
        files.save_manifest(spark, path, state)
    return report


def version_discontinuity(entries: DataFrame) -> DataFrame:
    return entries.agg((F.count_distinct("processor_version") > 1).alias("discontinuity"))


def closes(fetch: Callable[[Sequence[str]], DataFrame], symbols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Long prices of the symbols that a source has, and those it lacks."""
    from tephra.sources.scans import prices

    got, lacking = prices(fetch(list(dict.fromkeys(symbols))), list(dict.fromkeys(symbols)))
    if got.isEmpty():
        raise MarketDataError("the source returned no prices")
    return got, lacking
