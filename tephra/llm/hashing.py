"""Uniform numbers from keys that Spark and other SQL engines compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 48


def text_hash(text: Column) -> Column:
    """Tells texts apart in joins; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def number(*parts: Column | str) -> Column:
    """A whole number below 2 ** 48 from the parts' text: the first 12 digits of their md5. A null part counts as ''."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def number_sql(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 12))::BIGINT"
