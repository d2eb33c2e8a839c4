"""Writers. Provenance goes beside the data, as Spark writes no footer of its own."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.operators.series import melt

PROVENANCE = "provenance"


def with_provenance(df: DataFrame, column: str, notes: Mapping[str, Any]) -> DataFrame:
    """Notes as metadata of a column, which Parquet written by Spark keeps."""
    return df.withMetadata(column, {PROVENANCE: json.dumps(dict(notes), sort_keys=True)})


def provenance(df: DataFrame, column: str) -> dict[str, Any]:
    return json.loads(df.schema[column].metadata.get(PROVENANCE, "{}"))


def write_index(df: DataFrame, path: str, notes: Mapping[str, Any]) -> None:
    with_provenance(df, "index_value", notes).write.mode("overwrite").parquet(path)


def write_target(wide: DataFrame, path: str, column: str, source: str, snapshot: str) -> None:
    """The main series as tidy rows, and the others as long rows beside it."""
    tag = lambda d: d.withColumn("source", F.lit(source)).withColumn("snapshot_date", F.lit(snapshot).cast("date"))
    tag(wide.select("date", F.col(column).alias("value"))).write.mode("overwrite").parquet(f"{path}/target")
    if aux := [c for c in wide.columns if c not in ("date", column)]:
        tag(melt(wide, ["date"], aux, "series", "value")).write.mode("overwrite").parquet(f"{path}/aux")


def write_overpasses(df: DataFrame, path: str, version: str) -> None:
    """Observations by year, so that reads of a span skip other years."""
    df.withColumn("year", F.year("time")).withColumn("processor_version", F.lit(version)).write.mode("append").partitionBy("year").parquet(path)


def write_cube(df: DataFrame, path: str) -> None:
    """A cube by year, in order of period and cell within files, for predicate pushdown."""
    df.withColumn("year", F.year("period")).repartition("year").sortWithinPartitions("period", "iy", "ix").write.mode("overwrite").partitionBy("year").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(spark: SparkSession, path: str, payload: Mapping[str, Any], text: str) -> None:
    """results.json and summary.txt through the session's file system."""
    from tephra.sources.files import write_text

    write_text(spark, f"{path}/results.json", json.dumps(payload, indent=2, sort_keys=True, default=str))
    write_text(spark, f"{path}/summary.txt", text)
