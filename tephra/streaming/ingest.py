"""Streams of observations: resumable ingest and period means with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tephra.functions.calendar import observation_id
from tephra.functions.cleaning import quality_mask


def period_means(stream: DataFrame, length: str = "7 days", late: str = "2 days", time: str = "time", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and coverage by window; a window closes once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.avg(value).alias("value"), (F.count(value) / F.count("*")).alias("coverage"))


def ingest(stream: DataFrame, path: str, checkpoint: str, qa_threshold: float = 0.75, late: str = "30 days") -> StreamingQuery:
    """Appends masked observations once each, by year; a restart goes on from the checkpoint."""
    masked = stream.withColumn("value", quality_mask(F.col("value"), F.col("qa"), qa_threshold)).withColumn("id", observation_id(F.col("time")))
    once = masked.withWatermark("time", late).dropDuplicatesWithinWatermark(["id", "iy", "ix"]).withColumn("year", F.year("time"))
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("year").trigger(availableNow=True).start()
