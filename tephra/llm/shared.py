"""The folder that driver and executors share, for cutting lineage; and the spread of small scans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set for checkpoint() if it isn't yet.

    Where the setting is missing and the master is local, as in tests, a temporary folder takes its place; a cluster
    without the setting is refused, as its executors share no local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if own := context.getCheckpointDir():
        return own
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def scanned(docs: DataFrame) -> bool:
    """Whether the rows come from a scan alone, without an exchange, so that their partitions are those of files."""
    return "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()


def spread(docs: DataFrame) -> DataFrame:
    """The rows over all cores, where they come from a scan of fewer parts (a small or unsplittable table)."""
    if not scanned(docs):
        return docs  # dealt out already
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs._jdf.queryExecution().toRdd().getNumPartitions() >= cores else docs.repartition(cores)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` from a Parquet table in the shared folder."""
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(table: DataFrame) -> None:
    """Deletes a table that `written` returned, once nothing reads it any more."""
    top = folder(table.sparkSession).rstrip("/")
    jvm, context = table.sparkSession._jvm, table.sparkSession._jsc
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getParent().getName() == top.rsplit("/", 1)[1]:
            p.getFileSystem(context.hadoopConfiguration()).delete(p, True)
