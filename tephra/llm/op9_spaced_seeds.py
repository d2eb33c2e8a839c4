"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

A document is contaminated by a benchmark item if `window` consecutive tokens of it line up with `window` consecutive
tokens of the item and at most `substitutions` of them differ. Tokens are runs of letters and digits, lower-cased.

Seeds are fixed masks: a mask reads some positions of its span and ignores the others, so a substitution at an
ignored position leaves the seed intact. Items have a seed of each mask at every token, documents at every STRIDE-th.
The masks are checked to leave a seed in every window for every choice of substitutions and every place of the
window in its document; finding is complete, and every hit is verified token by token around the seed.

A seed of an item carries the tokens around it that verification can need, of which there is a fixed number, so its
size doesn't grow with the item. The bytes of all seeds are counted first. Up to BLOCKS blocks of BLOCK_BYTES they are
broadcast, and documents stream past them in one stage, with no shuffle of texts or seeds; the seeds of a long item go
to several blocks. Beyond that, seeds of documents and items meet in a shuffle, and the documents that have hits are
joined to them for verification.

Null and empty texts are clean, as are documents shorter than the window. Items with fewer tokens than the window
(null and empty ones too) find nothing. Rows that repeat a document are judged each, alike. A null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.hashing import text_hash
from tephra.llm.shared import spread

WINDOW, SUBSTITUTIONS = 12, 2
MASKS = ("11011", "111001")
#: Documents have a seed of each mask at every STRIDE-th token, items at every token.
STRIDE = 2
#: Bytes of one broadcast of seeds, and number of broadcasts up to which documents are read again for each.
BLOCK_BYTES, BLOCKS = 64 << 20, 3


def complete(masks: Sequence[str], window: int, substitutions: int, stride: int = 1) -> bool:
    """Whether every choice of substituted positions in a window leaves some mask at some place intact.

    stride: masks stand at every stride-th token only, wherever the window begins.
    """
    for begin in range(stride):
        places = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(window - len(m) + 1) if (at + begin) % stride == 0]
        if not all(any(not place & set(gone) for place in places) for gone in combinations(range(window), substitutions)):
            return False
    return True


def _tokens(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _seeds(tokens: Column, number: int, mask: str, stride: int = 1) -> Column:
    """Hash of the positions that the mask reads, at every stride-th start."""
    read = [i for i, c in enumerate(mask) if c == "1"]
    every = F.transform(F.sequence(F.lit(0), F.size(tokens) - len(mask), F.lit(stride)), lambda s: F.xxhash64(F.lit(number), *[F.get(tokens, s + i) for i in read]))
    return F.when(F.size(tokens) >= len(mask), every).otherwise(F.array().cast("array<bigint>"))


def _near(item: Column, at: Column, room: int, window: int) -> Column:
    """The item's tokens from `room` before a seed to the end of a window that begins with it; NULL beyond the item."""
    return F.transform(F.sequence(F.lit(-room), F.lit(window - 1)), lambda o: F.get(item, at + o))


def _agree(doc: Column, at: Column, near: Column, room: int, span: int, window: int, substitutions: int) -> Column:
    """Whether some window that holds the whole seed lines up, but for the substitutions allowed."""
    same = F.transform(near, lambda x, i: F.coalesce((F.get(doc, at + i - room) == x).cast("int"), F.lit(-window)))
    begins = F.sequence(F.lit(room - (window - span) + 1), F.lit(room + 1))
    return F.exists(begins, lambda s: F.aggregate(F.slice(same, s, window), F.lit(0), lambda a, x: a + x) >= window - substitutions)


def _numbered(mask: int):
    return lambda seed, start: F.struct(seed.alias("seed"), start.alias("at"), F.lit(mask).alias("mask"))


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks: Sequence[str] = MASKS, stride: int = STRIDE, block_bytes: int = BLOCK_BYTES, most_blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, text_hash, items): each contaminated document and its items in order. text_hash: xxhash64 of the text."""
    if not complete(masks, window, substitutions, stride):
        raise ValueError(f"the masks {masks} miss some {substitutions} substitutions in {window} tokens")
    room = window - min(map(len, masks))
    known = items.select(F.col(item_id).cast("long").alias("item_id"), _tokens(F.col(item_text)).alias("item")).where(F.size("item") >= window)
    seed_bytes = 8 * (window + room) + 64  # the tokens around it, and a row's fixed parts
    blocks = max(1, -(-(known.agg(F.sum(F.size("item"))).first()[0] or 0) * len(masks) * seed_bytes // block_bytes))
    every = F.flatten(F.array(*[F.transform(_seeds(F.col("item"), m, mask), _numbered(m)) for m, mask in enumerate(masks)]))
    seeds = known.select("item_id", "item", F.explode(every).alias("x"))
    seeds = seeds.select("item_id", F.col("x.seed").alias("seed"), F.col("x.mask").alias("mask"), F.col("x.at").alias("item_at"), _near(F.col("item"), F.col("x.at"), room, window).alias("near"))
    own = spread(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), _tokens(F.col(text)).alias("tokens")).where(F.size("tokens") >= window)
    # seeds of documents stay bare numbers: their places tell mask and start
    parts = [_seeds(F.col("tokens"), m, mask, stride) for m, mask in enumerate(masks)]
    stream = own.select("doc_id", "text_hash", "tokens", F.posexplode(F.concat(*parts)).alias("place", "seed"))
    begins = [F.lit(0)]
    for mask in masks[:-1]:
        begins.append(begins[-1] + F.greatest(F.floor((F.size("tokens") - len(mask)) / stride).cast("int") + 1, F.lit(0)))
    begin = F.lit(0)
    for m in range(len(masks)):
        begin = F.when(F.col("mask") == m, begins[m]).otherwise(begin)
    at = (F.col("place") - begin) * stride
    verified = F.lit(False)
    for m, mask in enumerate(masks):
        verified = F.when(F.col("mask") == m, _agree(F.col("tokens"), F.col("at"), F.col("near"), room, len(mask), window, substitutions)).otherwise(verified)
    if blocks <= most_blocks:
        found = None
        for b in range(blocks):
            some = seeds.where(F.pmod(F.xxhash64("item_id", "item_at"), F.lit(blocks)) == b).drop("item_at") if blocks > 1 else seeds.drop("item_at")
            hits = stream.join(F.broadcast(some), "seed").withColumn("at", at).where(verified).select("doc_id", "text_hash", "item_id")
            found = hits if found is None else found.unionByName(hits)
    else:
        met = stream.select("doc_id", "text_hash", "place", "seed").join(seeds.drop("item_at"), "seed")
        texts = own.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "tokens")
        met = met.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
        found = met.withColumn("at", at).where(verified).select("doc_id", "text_hash", "item_id")
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` that no item overlaps, with all their columns."""
    found = overlaps(docs, items, doc_id, text, **how).select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"))
    same = (text_hash(F.col(text)) == F.col("__text_hash")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__doc_id"))
    return docs.join(found, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, contaminated, n_items, items) of every document; items: ids joined by commas."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnsRenamed({"doc_id": "__doc_id", "text_hash": "__text_hash"})
    own = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"))
    flagged = own.join(found, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__text_hash")), "left")
    n = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long")
    return flagged.select("doc_id", F.col("items").isNotNull().alias("contaminated"), n.alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"))


#: Searches start from four equal tokens in a row: two substitutions leave one of the three fours of a window whole.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark),
dg AS (SELECT r, i, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] AS g FROM d, unnest(range(1, len(t) - 2)) u(i)),
bg AS (SELECT item_id, j, t[j] || ' ' || t[j + 1] || ' ' || t[j + 2] || ' ' || t[j + 3] AS g FROM b, unnest(range(1, len(t) - 2)) u(j)),
diag AS (SELECT DISTINCT r, item_id, i - j AS s FROM dg JOIN bg USING (g)),
m AS (SELECT r, item_id, s, j, (d.t[j + s] = b.t[j])::INT AS same FROM diag JOIN d USING (r) JOIN b USING (item_id), unnest(range(greatest(1, 1 - s), least(len(b.t), len(d.t) - s) + 1)) u(j)),
win AS (SELECT r, item_id, sum(same) OVER w AS n, count(*) OVER w AS c FROM m WINDOW w AS (PARTITION BY r, item_id, s ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)),
hit AS (SELECT r, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, count(*) AS n FROM (SELECT DISTINCT r, item_id FROM win WHERE c = {WINDOW} AND n >= {WINDOW - SUBSTITUTIONS}) GROUP BY r)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items FROM d LEFT JOIN hit USING (r)
"""
