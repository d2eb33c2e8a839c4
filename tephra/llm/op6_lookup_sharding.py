"""Sharding by a permutation-filled lookup table, with DataFrame functions alone.

Each shard prefers the slots of a table of prime size in an order of its own (an offset and a stride from hashes of
its name). Shards take turns: each claims the first slot of its order that is still free, until the table is full, so
shares differ by one slot at most, and a shard that goes or comes moves few slots but its own. A document's slot is
the hash of its id modulo the prime; the table, whose size is the parameter `slots` and doesn't grow with the data,
is broadcast, and placing is one lookup.

A null doc_id is placed as ''. Repeated rows go to the same shard. Columns of the input named `slot` or `shard` are
replaced. An empty table stays empty, with the columns added.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.hashing import number, number_sql

SHARDS, SLOTS = 64, 65_537


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The shard (its place in the list) of each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names and a slot each")
    digest = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    stride = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    table, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            if not free:
                break
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % slots
            table[at[shard]] = shard
            free -= 1
    return table


def names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def shard(docs: DataFrame, doc_id: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """`docs` with slot (int) and shard (int, the place in the list of shards)."""
    table = lookup_table(names(shards) if isinstance(shards, int) else shards, slots)
    packed = F.lit(bytearray(b"".join(s.to_bytes(4, "big") for s in table)))
    slot = F.col("id").cast("int")
    filled = docs.sparkSession.range(slots).select(slot.alias("slot"), F.conv(F.hex(F.substring(packed, slot * 4 + 1, F.lit(4))), 16, 10).cast("int").alias("shard"))
    own = docs.drop("slot", "shard").withColumn("slot", F.pmod(number(F.col(doc_id)), F.lit(slots)).cast("int"))
    return own.join(F.broadcast(filled), "slot").select(*[c for c in own.columns if c != "slot"], "slot", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


ORACLE = f"""
WITH t AS (SELECT string_split('{",".join(map(str, lookup_table(names(SHARDS), SLOTS)))}', ',') AS t),
s AS (SELECT doc_id, ({number_sql("doc_id")} % {SLOTS})::INT AS slot FROM documents)
SELECT doc_id, slot, t.t[slot + 1]::INT AS shard FROM s, t
"""
