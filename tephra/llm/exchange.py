"""Questions that batches of documents put to buckets of hashes, and the answers that come back.

Counting a hash over a corpus as one row each costs a shuffle of rows and puts a frequent hash into one task.
Here a batch of documents sends each hash once, packed with the others of the same bucket into one value, so
the most frequent hash reaches its bucket at most once from each batch, whatever its count. The bucket answers
entry by entry, in the order of the request; the batch, which makes its request anew from the same documents,
needs no hashes back. A bucket gets at most one value from each batch and none without hashes, so there are never
more values than there are distinct hashes in batches, however many batches meet however many buckets. All three
steps are plain stages over shuffled files: a lost executor's part is redone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.llm.shared import folder, scanned
from tephra.llm.text import U64

#: Text bytes of a batch once there are many; a batch is what one Python call holds.
BATCH_BYTES = 8 << 20
#: Batches that a small corpus is dealt to, as long as each has SMALL_BYTES.
FEW, SMALL_BYTES = 64, 1 << 19


def batch_of(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n)).cast("int")


def batches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by_id: bool = False, most: int = BATCH_BYTES, salted: bool = True) -> tuple[DataFrame, int]:
    """(batch, doc_id, text) of every row and the number of batches, from the corpus' own size.

    by_id: the batch of a doc_id is batch_of(xxhash64(doc_id), n), so that other tables can be dealt alike. most: text
    bytes of a batch. salted: rows of one id and text, which may be a large part of a table, go to batches by the part
    of the scan they come from (rows without an id do so where `by_id` holds too). Parts of a scan are the same when a
    lost task runs again; rows that have been through an exchange, where they may not be, go by id and text alone.
    """
    folder(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, math.ceil(total / most), min(FEW, math.ceil(total / SMALL_BYTES)))
    part = [F.spark_partition_id()] if scanned(docs) else []
    if by_id:
        key = F.when(F.col(doc_id).isNotNull(), batch_of(F.xxhash64(doc_id), n)).otherwise(batch_of(F.xxhash64(F.col(text), *part), n))
    else:
        key = batch_of(F.xxhash64(F.col(doc_id), F.col(text), *(part if salted else [])), n)
    return docs.select(key.alias("batch"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), n


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets as equal ranges of the hash, so that sorted hashes fall into slices."""
    return (((keys >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def slices(sorted_keys: np.ndarray, n: int):
    """(bucket, start, end) of each bucket that has keys."""
    if not len(sorted_keys):
        return
    b = bucket_of(sorted_keys, n)
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    for s, e in zip(cut, np.append(cut[1:], len(b)), strict=True):
        yield int(b[s]), int(s), int(e)
