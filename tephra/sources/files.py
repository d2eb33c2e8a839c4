"""Small files through the session's Hadoop file system, so that any store it knows will do."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    fs, p = _open(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


EMPTY = {"overpasses": {}, "batches_done": [], "batch_errors": {}}


def load_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """The manifest, or an empty one where there is none yet."""
    return json.loads(read_text(spark, path)) if exists(spark, path) else json.loads(json.dumps(EMPTY))


def save_manifest(spark: SparkSession, path: str, manifest: dict[str, Any]) -> None:
    write_text(spark, path, json.dumps(manifest, indent=1, sort_keys=True))
