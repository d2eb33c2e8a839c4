"""Scans that leave canonical names, explicit types and NULL for what is missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tephra.config import ACTIVE_STATUS
from tephra.errors import ColumnError, SourceError
from tephra.functions.cleaning import missing, number, require
from tephra.operators.series import dedup, melt

# Rows of metadata that a snapshot has under its header.
METADATA_LABELS = ("Name", "Region", "Frequency", "Unit", "Source", "Status", "Updated")

FACILITY_SCHEMA = "name string, latitude double, longitude double, technology string, status string"
CALENDAR_SCHEMA = "start date, end date, direction string, cause string"
COORDINATES = {"lon": ("lon", "x", "longitude"), "lat": ("lat", "y", "latitude")}


def snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file. One file is one task here, as line numbers are an order over all of it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return lines.where(F.length(F.trim("value")) > 0)


def wide_snapshot(lines: DataFrame, column: str, aux: Sequence[str] = ()) -> DataFrame:
    """(date, name, value) from the numbered lines of a snapshot: a line to skip, a header, metadata rows, dated rows.

    The main column must be there, others may be. Placeholders and text are NULL; of a date that repeats, the last
    line counts.
    """
    header = lines.orderBy("line_no").limit(2).collect()
    if len(header) < 2:
        raise SourceError("the snapshot has no header")
    names = [c.strip().strip('"') for c in header[1]["value"].split(",")]
    if column not in names:
        raise ColumnError(f"the snapshot lacks the column {column}")
    wanted = [column, *[a for a in aux if a in names]]
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = lines.where(F.col("line_no") > header[1]["line_no"]).select("line_no", F.from_csv("value", schema).alias("r"))
    label = F.trim("r.c0")
    dated = rows.where(~label.isin(*METADATA_LABELS)).withColumn("date", F.try_to_timestamp(label).cast("date")).where(F.col("date").isNotNull())
    long = dated.select("line_no", "date", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), number(F.col(f"r.c{names.index(n)}")).alias("value")) for n in wanted])).alias("x")).select("line_no", "date", "x.*")
    return dedup(long, ["date", "name"], [F.desc("line_no")]).select("date", "name", "value")


def facilities(spark: SparkSession, path: str, status: Sequence[str] = ACTIVE_STATUS) -> DataFrame:
    df = require(spark.read.option("header", True).csv(path), ["latitude", "longitude", "status"], "the facility table")
    return df.select([c for c in df.columns if c not in ("latitude", "longitude")] + [F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]).where(F.col("status").isin(*status))


def curtailment_calendar(spark: SparkSession, path: str | None) -> DataFrame:
    """Intervals, or an empty frame of their type without a path."""
    if path is None:
        return spark.createDataFrame([], CALENDAR_SCHEMA)
    df = require(spark.read.option("header", True).csv(path), ["start", "end", "direction"], "the calendar")
    cause = F.col("cause") if "cause" in df.columns else F.lit(None)
    return df.select(F.to_date("start").alias("start"), F.to_date("end").alias("end"), "direction", F.coalesce(cause.cast("string"), F.lit("curtailment")).alias("cause"))


def cube(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A stored cube, or a span of its periods; years outside the span aren't read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where((F.col("year") >= int(first[:4])) & (F.col("period") >= F.lit(first).cast("date")))
    if last is not None:
        df = df.where((F.col("year") <= int(last[:4])) & (F.col("period") <= F.lit(last).cast("date")))
    return df.drop("year")


def canonical_grid(df: DataFrame, bands: Mapping[str, str] | None = None) -> DataFrame:
    """Coordinates as lon, lat and time, bands under standard names, NaN as NULL."""
    for to, known in COORDINATES.items():
        found = next((c for c in known if c in df.columns), None)
        if found is None:
            raise ColumnError(f"no coordinate among {', '.join(known)}")
        df = df.withColumnRenamed(found, to)
    for old, new in {"t": "time", "valid_time": "time", **(bands or {})}.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    df = df.drop("crs", "number", "expver")
    return df.select([missing(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def dedup_times(parts: Sequence[DataFrame], first: str, last: str, keys: Sequence[str] = ("time", "iy", "ix")) -> DataFrame:
    """Yearly parts as one: of a time that repeats the earlier part counts; trimmed to a span of dates."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    return dedup(every.where(F.to_date("time").between(first, last)), keys, [F.asc("__part")]).drop("__part")


def prices(wide: DataFrame, symbols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Long closes (date, symbol, close) of a wide table and the symbols it lacks; missing closes are dropped."""
    have = [s for s in symbols if s in wide.columns]
    return melt(wide, ["date"], have, "symbol", "close"), [s for s in symbols if s not in have]


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols once each, in the order of their first place: (i, symbol)."""
    return symbols.groupBy("symbol").agg(F.min("i").alias("i")).withColumn("i", F.row_number().over(Window.orderBy("i")))


def latest_snapshot(spark: SparkSession, folder: str, pattern: str) -> str:
    """The last path in order of name that fits a pattern. Only names are listed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).agg(F.max("path")).first()[0]
    if found is None:
        raise SourceError(f"no file {pattern} in {folder}")
    return found


MANIFEST_ENTRY = "struct<fetched_at:string,processor_version:string,valid_coverage:double,cloud_mean:double,no2_mean:double,path:string,qa_threshold:double>"
MANIFEST_SCHEMA = f"overpasses map<string,{MANIFEST_ENTRY}>, batches_done array<string>, batch_errors map<string,string>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an overpass (id, its entry's fields) of a JSON manifest."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path).select(F.explode("overpasses").alias("id", "e")).select("id", "e.*")


def clear_days(entries: DataFrame, max_cloud: float = 0.3, min_coverage: float = 0.5, n: int = 3) -> DataFrame:
    """The n overpasses of highest mean among clear and well covered ones; unknown cloud passes."""
    clear = F.col("no2_mean").isNotNull() & (F.col("cloud_mean").isNull() | (F.col("cloud_mean") <= max_cloud)) & (F.col("valid_coverage") >= min_coverage)
    return entries.where(clear).orderBy(F.desc("no2_mean"), "id").limit(n)
