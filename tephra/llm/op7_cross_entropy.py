"""LM scoring by cross-entropy difference of two matched bigram models.

The target model is counted over the documents that `labels` call good (quality 1), the background model over all
documents. Both are bigram models of the same order and smoothing over one vocabulary, the words that the corpus has
at least LEAST times. A word's probability after another is its bigram count, smoothed towards its unigram count
(Dirichlet prior of weight PRIOR), and that towards the uniform distribution over the vocabulary and one unknown word.
A document's score is the mean over its words of the difference of their losses in bits, target less background: the
lower, the more it reads like the target. Its own counts are taken out of both models first, so no document is scored
by itself.

Counting goes through buckets of hashes (see `exchange`): a batch sends each distinct word and bigram once, with its
counts, and learns the counts of the whole corpus. The model is nowhere in one place, so it has no bound to cap it, and
a word that every document has is one entry of each batch.

Words are runs of other characters than space and 0x09 to 0x0D, A-Z as a-z. Null and empty texts have no words:
n_words 0 and NULL losses. A null doc_id is background. Rows that repeat count each. Labels are read by doc_id: good if
any row says so; null labels are not good. Without good documents the target model is uniform. Words and bigrams are
told apart by 48 bits of a hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.exchange import batch_of, batches, slices
from tephra.llm.text import U64, mix, planes, tokens, unplanes, utf8

PRIOR, LEAST = 2.0, 2
#: Text bytes of a batch: words and bigrams take more memory than the anchors of other operators.
BATCH = 4 << 20
REQUEST = "bucket int, batch int, data binary, n_all long, n_target long, n_known long, n_rare long, rare_target long"


SIZES = ("n_all", "n_target", "n_known", "n_rare", "rare_target")


def _reply(rows: list[tuple]) -> pa.Table:
    names = [c.split() for c in REQUEST.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(v, kinds[k]) for (n, k), v in zip(names, columns, strict=True)})


class Counts:
    """Words and bigrams of a batch: for each place its entry among the distinct keys, sorted by 48 bits of hash.

    A word's lowest bit is 0 and a bigram's 1.
    """

    def __init__(self, docs: pa.Table, good: pa.Table):
        buf, off = utf8(docs["text"])
        _, _, word, self.of = tokens(buf, off, lower=True)
        ids = good["doc_id"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if good.num_rows else np.zeros(0, np.int64)
        known = docs["doc_id"].combine_chunks()
        self.good = np.isin(known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids) & ~known.is_null().to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(docs.num_rows), np.diff(self.of))
        follows = np.ones(len(word), bool)
        follows[self.of[:-1][np.diff(self.of) > 0]] = False
        self.after = np.flatnonzero(follows)  # words that have one before them
        w48 = (mix(word) >> U64(16)) & ~U64(1)
        pair = (mix(word[self.after - 1] * U64(3) + word[self.after]) >> U64(16)) | U64(1)
        self.keys, inv = np.unique(np.concatenate([w48, pair]), return_inverse=True)
        self.word, self.pair = inv[: len(word)], inv[len(word) :]
        mine = self.good[self.doc]
        n = len(self.keys)
        self.all = np.bincount(inv, minlength=n)
        self.target = np.bincount(np.concatenate([self.word[mine], self.pair[mine[self.after]]]), minlength=n)

    def own(self, entry: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often the document itself has each entry."""
        key = doc * np.int64(len(self.keys) + 1) + entry
        _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
        return count[inv]


def _ask(n: int):
    def f(docs: pa.Table, good: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _reply([])
        c, batch = Counts(docs, good), docs["batch"][0].as_py()
        return _reply([(b, batch, planes(np.diff(c.keys[i:j], prepend=U64(0))) + planes(c.all[i:j].astype(np.uint32)) + planes(c.target[i:j].astype(np.uint32)), 0, 0, 0, 0, 0) for b, i, j in slices(c.keys << U64(16), n)])

    return f


def _total(least: int):
    def f(table: pa.Table) -> pa.Table:
        bucket, batch, data = table["bucket"][0].as_py(), table["batch"].to_pylist(), table["data"].to_pylist()
        sizes = [len(d) // 16 for d in data]
        part = lambda a, b, t: np.concatenate([unplanes(d[a * m : b * m], t) for d, m in zip(data, sizes, strict=True)])
        keys = np.concatenate([np.cumsum(unplanes(d[: 8 * m], U64), dtype=U64) for d, m in zip(data, sizes, strict=True)])
        distinct, inv = np.unique(keys, return_inverse=True)
        both = [np.bincount(inv, part(a, b, np.uint32)).astype(np.int64) for a, b in ((8, 12), (12, 16))]
        word = (distinct & U64(1)) == 0
        rare = word & (both[0] < least)
        stats = (int(both[0][word].sum()), int(both[1][word].sum()), int((word & ~rare).sum()), int(both[0][rare].sum()), int(both[1][rare].sum()))
        cut = np.cumsum([0, *sizes])
        rows = []
        for k, (b, i, j) in enumerate(zip(batch, cut[:-1], cut[1:], strict=True)):
            body = b"".join(planes(np.minimum(v[inv[i:j]], 2**32 - 1).astype(np.uint32)) for v in both)
            rows.append((bucket, b, zlib.compress(body, 1), *(stats if k == 0 else (0,) * 5)))
        return _reply(rows)

    return f


def _losses(c: Counts, total: np.ndarray, size: int, n_known: int, n_rare: int, member: np.ndarray, prior: float, least: int, total_all: np.ndarray) -> np.ndarray:
    """Bits of each word under one model, with its document left out where it is a member.

    total: counts of the model by entry; size, n_rare: its words, and those outside the vocabulary.
    """
    inside = member[c.doc]
    own_word = c.own(c.word, c.doc)
    length = np.diff(c.of)[c.doc]
    known = total_all[c.word] >= least
    own = np.where(inside, own_word, 0)
    rare_in_doc = np.bincount(c.doc, ~known, minlength=len(c.of) - 1)[c.doc]
    count = np.where(known, total[c.word] - own, n_rare - np.where(inside, rare_in_doc, 0))
    unigram = (count + 1) / (size - np.where(inside, length, 0) + n_known + 1)
    p = unigram.copy()
    a = c.after
    before = c.word[a - 1]
    context = np.where(known[a - 1], total[before] - np.where(inside[a], own_word[a - 1], 0), 0)
    joint = np.where(known[a] & known[a - 1], total[c.pair] - np.where(inside[a], c.own(c.pair, c.doc[a]), 0), 0)
    p[a] = (joint + prior * unigram[a]) / (context + prior)
    return -np.log2(p)


def _score(n: int, prior: float, least: int):
    def f(docs: pa.Table, right: pa.Table) -> pa.Table:
        sizes = {c: sum(v for v in right[c].to_pylist() if v) for c in SIZES}
        good = right.filter(pa.compute.is_valid(right["doc_id"]))
        c = Counts(docs, good)
        answers = right.filter(pa.compute.is_valid(right["data"]))
        answers = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True))
        every, target = np.zeros(len(c.keys), np.int64), np.zeros(len(c.keys), np.int64)
        for b, i, j in slices(c.keys << U64(16), n):
            body = zlib.decompress(answers[b])
            every[i:j], target[i:j] = unplanes(body[: 4 * (j - i)], np.uint32), unplanes(body[4 * (j - i) :], np.uint32)
        n_words = np.diff(c.of)
        means = []
        for total, size, rare, member in ((target, sizes["n_target"], sizes["rare_target"], c.good), (every, sizes["n_all"], sizes["n_rare"], np.ones(docs.num_rows, bool))):
            bits = _losses(c, total, size, sizes["n_known"], rare, member, prior, least, every)
            means.append(np.bincount(c.doc, bits, minlength=docs.num_rows) / np.maximum(n_words, 1))
        empty = n_words == 0
        column = lambda v: pa.array(v, mask=empty)
        return pa.table({"doc_id": docs["doc_id"], "n_words": n_words, "target_bits": column(means[0]), "background_bits": column(means[1]), "score": column(means[0] - means[1])})

    return f


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", prior: float = PRIOR, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, target_bits, background_bits, score) of every row of `docs`."""
    own, n = batches(docs, doc_id, text, by_id=True, most=BATCH)
    good = labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    good = good.select(batch_of(F.xxhash64("doc_id"), n).alias("batch"), "doc_id")
    first = own.groupBy("batch").cogroup(good.groupBy("batch")).applyInArrow(_ask(n), REQUEST).groupBy("bucket").applyInArrow(_total(least), REQUEST)
    # the sizes of the models go to every batch as a row; one plan, so that the texts are dealt out once
    sizes = first.agg(*[F.sum(c).alias(c) for c in SIZES]).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = first.select("bucket", "batch", "data").unionByName(good, allowMissingColumns=True).unionByName(sizes, allowMissingColumns=True)
    return own.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(_score(n, prior, least), "doc_id long, n_words long, target_bits double, background_bits double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
