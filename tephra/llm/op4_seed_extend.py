"""Substring dedup by seed and extend: words inside a window of `width` words that also starts in an earlier document.

Seeds are winnowed anchors: the least k-word gram of each window, so equal windows share an anchor and every window
has exactly one. The windows of one anchor are a run of starts; the words they span are its context. Batches of
documents join on anchors through buckets of hashes (see `exchange`):

1. For each anchor and context a batch sends its smallest doc_id, and learns the smallest of all. A document after that
   one has the whole context removed, so a copy costs its batch one entry.
2. Where an anchor has several contexts, the first document of each sends the words. The anchor's bucket extends all
   of them from the seed, word by word to the left and to the right: contexts stay together as long as their words
   agree, and each window learns the smallest document whose words agree over all of it.
3. An anchor with more than HOT contexts would make one bucket large, so its windows are looked up by hash instead,
   spread over all buckets. That is exact too; nothing is dropped.

Windows that overlap or touch make the maximal repeats. Documents without words give 0, 0 and the digest of nothing.
A null doc_id is no smaller than any and nothing is smaller than it: its text stays. Rows that repeat a doc_id stay as
well, as neither is smaller. Words are compared as they are written, by 64-bit hashes; contexts and the windows of hot
anchors by one hash of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.exchange import batches, slices
from tephra.llm.text import U64, Hashes, anchors, covered, joined, mix, planes, tokens, unplanes, utf8

WIDTH, K = 13, 5
#: Contexts of one anchor from which windows are looked up by hash and not extended.
HOT = 512
#: Stands for a null doc_id.
NONE = np.iinfo(np.int64).max

REQUEST = "kind int, bucket int, batch int, data binary"


def reply(rows: list[tuple]) -> pa.Table:
    kind, bucket, batch, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "batch": pa.array(batch, pa.int32()), "data": pa.array(data, pa.binary())})


def least(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, the least value of each, and the number of the key of each entry."""
    by = np.lexsort((values, *reversed(keys)))
    new = np.zeros(len(by), bool)
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    new[:1] = True
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new) - 1
    one = by[new]
    return [k[one] for k in keys], values[one], group


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 .. of each, `count` long."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Seeds:
    def __init__(self, table: pa.Table, width: int, k: int):
        self.buf, off = utf8(table["text"])
        self.start, self.end, self.word, self.of = tokens(self.buf, off)
        self.doc = table["doc_id"].combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashes = Hashes(self.word)
        self.at, self.first, self.last = anchors(self.hashes.every(k), self.of, width, k)
        anchor = mix(self.hashes.of(self.at, self.at + k))  # a least hash is small; mixed again, anchors spread over the buckets
        shape = (self.at - self.first).astype(U64) * U64(0x632BE59BD9B4E019) + (self.last - self.first).astype(U64)
        context = mix(self.hashes.of(self.first, self.last + width) + shape)
        self.own = self.doc[np.searchsorted(self.of, self.at, "right") - 1]
        (self.anchor, self.context), self.smallest, self.group = least([anchor, context], self.own)
        self.one = np.empty(len(self.anchor), np.int64)
        self.one[self.group] = np.arange(len(self.group))  # an occurrence of each context


def _ask(n: int, width: int, k: int):
    def f(table: pa.Table) -> pa.Table:
        s, batch = Seeds(table, width, k), table["batch"][0].as_py()
        return reply([(0, b, batch, planes(s.anchor[i:j]) + planes(s.context[i:j]) + planes(s.smallest[i:j])) for b, i, j in slices(s.anchor, n)])

    return f


def _meet(hot: int):
    """Of each entry: the smallest document of its context, and whether its anchor has other contexts (1) or too many (2)."""

    def f(table: pa.Table) -> pa.Table:
        bucket, batch, data = table["bucket"][0].as_py(), table["batch"].to_pylist(), table["data"].to_pylist()
        sizes = [len(d) // 24 for d in data]
        a, x, v = (np.concatenate([unplanes(d[c * m * 8 : (c + 1) * m * 8], t) for d, m in zip(data, sizes, strict=True)]) for c, t in ((0, U64), (1, U64), (2, np.int64)))
        (anchor, _), smallest, group = least([a, x], v)
        of = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])) - 1
        contexts = np.bincount(of)[of]
        code = ((contexts > 1).astype(np.uint8) + (contexts > hot))[group]
        cut = np.cumsum([0, *sizes])
        return reply([(0, bucket, b, planes(smallest[group[i:j]]) + code[i:j].tobytes()) for b, i, j in zip(batch, cut[:-1], cut[1:], strict=True)])

    return f


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: d for k, b, d in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind}


class Questions:
    """What a batch still has to ask: contexts to extend, and windows of hot anchors to look up."""

    def __init__(self, s: Seeds, answers: dict[int, bytes], n: int, width: int):
        self.smallest, code = np.empty(len(s.anchor), np.int64), np.empty(len(s.anchor), np.uint8)
        for b, i, j in slices(s.anchor, n):
            self.smallest[i:j] = unplanes(answers[b][: 8 * (j - i)], np.int64)
            code[i:j] = np.frombuffer(answers[b][8 * (j - i) :], np.uint8)
        first = s.smallest == self.smallest  # the batch has the first document of the context
        self.contexts = np.flatnonzero(first & (code == 1))
        self.mine = s.own == self.smallest[s.group]
        hot = np.flatnonzero(self.mine & (code[s.group] == 2))
        self.hot = _spread(s.first[hot], count := (s.last - s.first)[hot] + 1)
        self.hot_own, self.hot_hash = np.repeat(s.own[hot], count), s.hashes.of(self.hot, self.hot + width)


def _extend(n: int, width: int, k: int):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return reply([])
        s, batch, rows = Seeds(docs, width, k), docs["batch"][0].as_py(), []
        q = Questions(s, _answers(answers, 0), n, width)
        for b, i, j in slices(s.anchor[q.contexts], n):
            some = q.contexts[i:j]
            one = s.one[some]
            size = s.last[one] + width - s.first[one]
            words = s.word[_spread(s.first[one], size)]
            rows.append((1, b, batch, np.int64(j - i).tobytes() + planes(s.smallest[some]) + planes((s.at - s.first)[one].astype(np.int32)) + planes(size.astype(np.int32)) + planes(words)))
        (keys,), smallest, _ = least([q.hot_hash], q.hot_own)
        rows += [(2, b, batch, planes(keys[i:j]) + planes(smallest[i:j])) for b, i, j in slices(keys, n)]
        return reply(rows)

    return f


def _rank(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def extended(doc: np.ndarray, lead: np.ndarray, size: np.ndarray, words: np.ndarray, width: int, k: int) -> np.ndarray:
    """Of each window of each context the smallest document whose words agree with it; lead: words before the seed."""
    begin = np.cumsum(size) - size
    at, after = begin + lead, size - lead - k
    token = _rank(words)
    most = int(token.max(initial=0)) + 1
    seed = np.zeros(len(doc), np.int64)
    for i in range(k):
        seed = _rank(seed * most + token[at + i])
    # contexts of one rank agree over the seed and as many words to the left, or to the right
    left, right = [seed], [seed]
    for i in range(1, width - k + 1):
        for ranks, has, place in ((left, lead >= i, at - i), (right, after >= i, at + k + i - 1)):
            rank = np.full(len(doc), -1)
            rank[has] = _rank(ranks[-1][has] * most + token[place[has]])
            ranks.append(rank)
    windows = size - width + 1
    out, out_begin = np.empty(int(windows.sum()), np.int64), np.cumsum(windows) - windows
    for i in range(width - k + 1):
        some = np.flatnonzero((lead >= i) & (after >= width - k - i))
        both = _rank(left[i][some] * len(doc) + right[width - k - i][some])
        first = np.full(int(both.max(initial=-1)) + 1, NONE)
        np.minimum.at(first, both, doc[some])
        out[out_begin[some] + lead[some] - i] = first[both]
    return out


def _second(width: int, k: int):
    def contexts(data: list[bytes]) -> list[bytes]:
        counts = [int(np.frombuffer(d[:8], np.int64)[0]) for d in data]
        part = lambda a, b, t: np.concatenate([unplanes(d[8 + a * m : 8 + b * m], t) for d, m in zip(data, counts, strict=True)])
        doc, lead, size = part(0, 8, np.int64), part(8, 12, np.int32).astype(np.int64), part(12, 16, np.int32).astype(np.int64)
        words = np.concatenate([unplanes(d[8 + 16 * m :], U64) for d, m in zip(data, counts, strict=True)])
        first = extended(doc, lead, size, words, width, k)
        cut = np.append(0, np.cumsum(size - width + 1))[np.cumsum([0, *counts])]
        return [planes(first[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def hashes(data: list[bytes]) -> list[bytes]:
        sizes = [len(d) // 16 for d in data]
        a, v = (np.concatenate([unplanes(d[c * m * 8 : (c + 1) * m * 8], t) for d, m in zip(data, sizes, strict=True)]) for c, t in ((0, U64), (1, np.int64)))
        _, smallest, group = least([a], v)
        cut = np.cumsum([0, *sizes])
        return [planes(smallest[group[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def f(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        out = (contexts if kind == 1 else hashes)(table["data"].to_pylist())
        return reply([(kind, bucket, b, d) for b, d in zip(table["batch"].to_pylist(), out, strict=True)])

    return f


def _remove(n: int, width: int, k: int):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        s = Seeds(docs, width, k)
        q = Questions(s, _answers(answers, 0), n, width)
        # whole contexts of later documents; then windows of first ones: (start, first document)
        later = np.flatnonzero((q.smallest[s.group] < s.own) & (s.own != NONE))
        count = (s.last - s.first)[later] + 1
        start, other = [_spread(s.first[later], count)], [np.repeat(q.smallest[s.group[later]], count)]
        found, firsts = _answers(answers, 1), []
        for b, _, _ in slices(s.anchor[q.contexts], n):
            firsts.append(unplanes(found[b], np.int64))
        firsts = np.concatenate([*firsts, np.zeros(0, np.int64)])
        windows = (s.last - s.first)[s.one[q.contexts]] + 1
        where = np.full(len(s.anchor), -1)
        where[q.contexts] = np.cumsum(windows) - windows
        mine = np.flatnonzero(q.mine & (where[s.group] >= 0))
        count = (s.last - s.first)[mine] + 1
        first = firsts[_spread(where[s.group[mine]], count)]
        gone = (first < (own := np.repeat(s.own[mine], count))) & (own != NONE)
        start.append(_spread(s.first[mine], count)[gone])
        other.append(first[gone])
        keys = np.unique(q.hot_hash)
        first, found = np.empty(len(keys), np.int64), _answers(answers, 2)
        for b, i, j in slices(keys, n):
            first[i:j] = unplanes(found[b], np.int64)
        first = first[np.searchsorted(keys, q.hot_hash)]
        gone = (first < q.hot_own) & (q.hot_own != NONE)
        start.append(q.hot[gone])
        other.append(first[gone])
        start, other = np.concatenate(start), np.concatenate(other)
        gone = covered(len(s.start), start, start + width)
        full = np.diff(s.of) > 0
        before, after = np.append(False, gone[:-1]), np.append(gone[1:], False)
        before[s.of[:-1][full]] = False
        after[s.of[1:][full] - 1] = False
        begins, ends = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        runs = np.searchsorted(begins, s.of)
        base = np.repeat(s.of[:-1], np.diff(runs))
        of_start = np.empty(len(s.start), np.int64)
        of_start[start] = other  # a run begins with a window
        spans = pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (begins - base, ends - base, of_start[begins])], ["start", "end", "other"]))
        kept = pa.array(joined(s.buf, s.start, s.end, s.of, ~gone), pa.binary()).cast(pa.string())
        return pa.table({"doc_id": docs["doc_id"], "n_words": np.diff(s.of), "kept": kept, "spans": spans})

    return f


def seed_extend_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_repeats, kept, spans) of every row of `docs`.

    kept: the words that stay, joined by one space; spans: (start, end, other) of each maximal repeat that is removed, in
    words of the input, with an earlier document that has its first window; n_repeats: their number.
    """
    own, n = batches(docs, doc_id, text)
    first = own.groupBy("batch").applyInArrow(_ask(n, width, k), REQUEST).groupBy("bucket").applyInArrow(_meet(hot), REQUEST)
    # read twice in one plan, which deals the texts and the questions out once
    second = own.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(_extend(n, width, k), REQUEST).groupBy("kind", "bucket").applyInArrow(_second(width, k), REQUEST)
    out = own.groupBy("batch").cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(_remove(n, width, k), "doc_id long, n_words long, kept string, spans array<struct<start:long,end:long,other:long>>")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_repeats"), "kept", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "spans")
