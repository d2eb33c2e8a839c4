"""A session with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC dates, strict arithmetic, plans that adapt at run time, and joins split where a key is hot.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "tephra", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()
