"""Paths for what is written and read again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tephra.errors import SourceError

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder where that isn't set and the master is local."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if top is None:
        if not context.master.startswith("local"):
            raise SourceError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="scratch-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        top = f"file://{_own[0]}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once, for what many branches of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
