"""Suffix-array dedup: bytes inside a string of `width` bytes that also starts elsewhere in the corpus.

Each window of `width` bytes has one anchor (its least k-gram), so equal windows meet under equal anchors. The
windows of one anchor are a run of starts; the bytes they span are its context. Batches of documents ask the
buckets of hashes (see `exchange`) about their contexts:

1. an anchor with a single context repeats nothing if that context occurs once, and everything if it recurs;
2. where an anchor has several contexts, one of each (not one of each occurrence) goes to the anchor's bucket,
   whose run-length index (see `runindex`) finds the starts with long matches among them;
3. an anchor with more than HOT contexts would make one bucket large, so its windows are counted by hash instead,
   spread over all buckets. That is exact too; nothing is dropped.

Nulls and empty texts have no bytes: 0, 0, 0 and the digest of nothing. Repeated rows are documents of their own
and match one another. Texts are read as UTF-8 bytes, and a removed run may split a character. Strings are judged
on the input, so the result doesn't depend on an order of removal. Equality of contexts and of the windows of hot
anchors is that of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.exchange import batches, slices
from tephra.llm.runindex import RunIndex
from tephra.llm.text import U64, Hashes, anchors, chunks, covered, mix, planes, unplanes, utf8

WIDTH, K = 200, 32
#: Contexts of one anchor from which they are counted by hash and not indexed.
HOT = 512
#: Bytes of text and number of contexts that one index holds.
INDEX_BYTES, INDEX_TEXTS = 512 << 10, 8192

# what the first answer says of a context
ALONE, REPEATED, ASKED, SENT, HOT_ANCHOR = 0, 1, 2, 4, 8


class Contexts:
    """Of all windows of a batch: by anchor, ordered by (anchor hash, context hash)."""

    def __init__(self, table: pa.Table, width: int, k: int):
        self.buf, self.off = utf8(table["text"])
        parts = []
        for i, j in chunks(self.off):
            base = int(self.off[i])
            off = self.off[i : j + 1] - base
            if off[-1] < width:
                continue
            h = Hashes.of_bytes(self.buf[base : base + int(off[-1])], 32)
            gram = h.every(k)
            at, first, last = anchors(gram, off, width, k)
            # a least hash is small; mixed again, anchors spread over the buckets
            shape = (at - first).astype(U64) * U64(0x632BE59BD9B4E019) + (last - first).astype(U64)
            parts.append((mix(gram[at]), mix(h.of(first, last + width) + shape), first + base, last + base))
        cat = lambda m, t: np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, t)
        self.anchor, self.context, self.first, self.last = cat(0, U64), cat(1, U64), cat(2, np.int64), cat(3, np.int64)
        order = np.lexsort((self.context, self.anchor))
        for name in ("anchor", "context", "first", "last"):
            setattr(self, name, getattr(self, name)[order])
        n = len(order)
        self.new = np.ones(n, bool)
        self.new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.context[1:] != self.context[:-1])
        self.one = np.flatnonzero(self.new)  # one of each
        self.twice = np.diff(np.append(self.one, n)) > 1
        self.group = np.cumsum(self.new) - 1


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    out = {}
    for k, bucket, data in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True):
        if k == kind:
            out[bucket] = data
    return out


REQUEST = "kind int, bucket int, batch int, data binary"


def _reply(rows: list[tuple]) -> pa.Table:
    kind, bucket, batch, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "batch": pa.array(batch, pa.int32()), "data": pa.array(data, pa.binary())})


def _ask(n: int, width: int, k: int):
    def f(table: pa.Table) -> pa.Table:
        c, batch, rows = Contexts(table, width, k), table["batch"][0].as_py(), []
        a, x, twice = c.anchor[c.one], c.context[c.one], c.twice
        for b, s, e in slices(a, n):
            rows.append((0, b, batch, planes(a[s:e]) + planes(x[s:e]) + twice[s:e].tobytes()))
        return _reply(rows)

    return f


def _judge(hot: int):
    def f(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        batch, data = table["batch"].to_pylist(), table["data"].to_pylist()
        order = sorted(range(len(batch)), key=lambda i: batch[i])
        sizes = [len(data[i]) // 17 for i in order]
        a = np.concatenate([unplanes(data[i][: 8 * m], U64) for i, m in zip(order, sizes, strict=True)])
        x = np.concatenate([unplanes(data[i][8 * m : 16 * m], U64) for i, m in zip(order, sizes, strict=True)])
        twice = np.concatenate([np.frombuffer(data[i][16 * m :], bool) for i, m in zip(order, sizes, strict=True)])
        by = np.lexsort((np.arange(len(a)), x, a))
        new_a = np.append(True, a[by][1:] != a[by][:-1])
        new_x = new_a | np.append(True, x[by][1:] != x[by][:-1])
        ctx, anc = np.cumsum(new_x) - 1, np.cumsum(new_a) - 1
        again = (np.bincount(ctx) > 1) | (np.bincount(ctx, twice[by]) > 0)  # occurs more than once
        anchor_of = anc[new_x]
        kinds = np.bincount(anchor_of)  # contexts of each anchor
        needed = (np.bincount(anchor_of, ~again) > 0) & (kinds > 1)  # some context of the anchor asks
        code = np.where(again[ctx], REPEATED, np.where(kinds[anc] > 1, ASKED, ALONE))
        code = code | np.where(needed[anc] & new_x, SENT, 0) | np.where(kinds[anc] > hot, HOT_ANCHOR, 0)
        out = np.empty(len(a), np.uint8)
        out[by] = code
        cut = np.cumsum([0, *sizes])
        return _reply([(0, bucket, batch[i], out[s:e].tobytes()) for i, s, e in zip(order, cut[:-1], cut[1:], strict=True)])

    return f


def _codes(c: Contexts, answers: dict[int, bytes], n: int) -> np.ndarray:
    code = np.zeros(len(c.one), np.uint8)
    for b, s, e in slices(c.anchor[c.one], n):
        code[s:e] = np.frombuffer(answers[b], np.uint8)
    return code


def _sent(c: Contexts, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that go to an index, and those whose windows are counted by hash."""
    sent = (code & SENT) > 0
    hot = (code & HOT_ANCHOR) > 0
    return np.flatnonzero(sent & ~hot), np.flatnonzero(sent & hot)


def _windows(c: Contexts, some: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of the contexts numbered `some`, and the number of windows of each."""
    where = c.one[some]
    first, count = c.first[where], c.last[where] - c.first[where] + 1
    out = np.empty(int(count.sum()), U64)
    begin = np.cumsum(count) - count
    # contexts are read by document part, as hashes are prefix sums over it
    order = np.argsort(first)
    pos = 0
    for i, j in chunks(c.off):
        lo, hi = int(c.off[i]), int(c.off[j])
        end = pos + int(np.searchsorted(first[order[pos:]], hi))
        if end == pos:
            continue
        h = Hashes.of_bytes(c.buf[lo:hi]).every(width)
        for o in order[pos:end]:
            out[begin[o] : begin[o] + count[o]] = h[first[o] - lo : first[o] - lo + count[o]]
        pos = end
    return out, count


def _send(n: int, width: int, k: int):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _reply([])
        c, batch, rows = Contexts(docs, width, k), docs["batch"][0].as_py(), []
        code = _codes(c, _answers(answers, 0), n)
        texts, counted = _sent(c, code)
        a = c.anchor[c.one[texts]]
        for b, s, e in slices(a, n):
            w = c.one[texts[s:e]]
            first, end = c.first[w], c.last[w] + width
            body = b"".join(c.buf[p:q].tobytes() for p, q in zip(first, end, strict=True))
            asked = ((code[texts[s:e]] & ASKED) > 0).astype(np.uint8)
            rows.append((1, b, batch, np.int64(e - s).tobytes() + planes(a[s:e]) + planes((end - first).astype(np.int32)) + asked.tobytes() + body))
        if len(counted):
            keys = np.unique(_windows(c, counted, width)[0], return_counts=True)
            for b, s, e in slices(keys[0], n):
                rows.append((2, b, batch, planes(keys[0][s:e]) + (keys[1][s:e] > 1).tobytes()))
        return _reply(rows)

    return f


def _index(width: int, index_bytes: int, index_texts: int):
    def texts(bucket, batch, data) -> list[tuple]:
        counts = [int(np.frombuffer(d[:8], np.int64)[0]) for d in data]
        a = np.concatenate([unplanes(d[8 : 8 + 8 * m], U64) for d, m in zip(data, counts, strict=True)])
        length = np.concatenate([unplanes(d[8 + 8 * m : 8 + 12 * m], np.int32) for d, m in zip(data, counts, strict=True)]).astype(np.int64)
        asked = np.concatenate([np.frombuffer(d[8 + 12 * m : 8 + 13 * m], np.uint8) for d, m in zip(data, counts, strict=True)]).astype(bool)
        body = np.concatenate([np.frombuffer(d[8 + 13 * m :], np.uint8) for d, m in zip(data, counts, strict=True)])
        off = np.cumsum(length) - length
        starts = length - width + 1
        found = np.zeros(int(starts.sum()), bool)
        begin = np.cumsum(starts) - starts
        order = np.argsort(a, kind="stable")
        cut = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))
        cut = np.append(cut, len(order))
        size = np.append(0, np.cumsum(length[order]))
        i = 0
        while i < len(cut) - 1:  # whole anchors, up to the size of an index
            j = i + 1
            while j < len(cut) - 1 and size[cut[j + 1]] - size[cut[i]] <= index_bytes and cut[j + 1] - cut[i] <= index_texts:
                j += 1
            own = order[cut[i] : cut[j]]
            if len(own) > 1:
                index = RunIndex(np.concatenate([body[off[o] : off[o] + length[o]] for o in own]), np.append(0, np.cumsum(length[own])), width)
                hit, at = index.repeated(), 0
                for o in own:
                    found[begin[o] : begin[o] + starts[o]] = hit[at : at + starts[o]]
                    at += starts[o]
            i = j
        rows, m0, s0 = [], 0, 0
        for b, m in zip(batch, counts, strict=True):
            s1 = s0 + int(starts[m0 : m0 + m].sum())
            want = np.repeat(asked[m0 : m0 + m], starts[m0 : m0 + m])
            rows.append((1, bucket, b, np.packbits(found[s0:s1][want]).tobytes()))
            m0, s0 = m0 + m, s1
        return rows

    def hashes(bucket, batch, data) -> list[tuple]:
        sizes = [len(d) // 9 for d in data]
        keys = np.concatenate([unplanes(d[: 8 * m], U64) for d, m in zip(data, sizes, strict=True)])
        twice = np.concatenate([np.frombuffer(d[8 * m :], bool) for d, m in zip(data, sizes, strict=True)])
        _, inv = np.unique(keys, return_inverse=True)
        again = ((np.bincount(inv) > 1) | (np.bincount(inv, twice) > 0))[inv]
        cut = np.cumsum([0, *sizes])
        return [(2, bucket, b, np.packbits(again[s:e]).tobytes()) for b, s, e in zip(batch, cut[:-1], cut[1:], strict=True)]

    def f(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        return _reply((texts if kind == 1 else hashes)(bucket, table["batch"].to_pylist(), table["data"].to_pylist()))

    return f


def _remove(n: int, width: int, k: int):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = Contexts(docs, width, k)
        code = _codes(c, _answers(answers, 0), n)
        whole = ((code & REPEATED) > 0)[c.group]
        start, end = [c.first[whole]], [c.last[whole] + width]
        texts, counted = _sent(c, code)
        found = _answers(answers, 1)
        for b, s, e in slices(c.anchor[c.one[texts]], n):
            w = texts[s:e][(code[texts[s:e]] & ASKED) > 0]
            if not len(w):
                continue
            first, count = c.first[c.one[w]], (c.last - c.first)[c.one[w]] + 1
            bits = np.unpackbits(np.frombuffer(found[b], np.uint8), count=int(count.sum())).astype(bool)
            at = (np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(bits)))[bits]
            start.append(at)
            end.append(at + width)
        if len(counted):
            hashes, count = _windows(c, counted, width)
            keys = np.unique(hashes)
            again, found = np.zeros(len(keys), bool), _answers(answers, 2)
            for b, s, e in slices(keys, n):
                again[s:e] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=e - s).astype(bool)
            bits = again[np.searchsorted(keys, hashes)]
            first = c.first[c.one[counted]]
            at = (np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(bits)))[bits]
            start.append(at)
            end.append(at + width)
        gone = covered(len(c.buf), np.concatenate(start), np.concatenate(end))
        before = np.append(False, gone[:-1])
        before[c.off[:-1][np.diff(c.off) > 0]] = False
        sums, runs = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(gone & ~before))
        removed, spans = np.diff(sums[c.off]), np.diff(runs[c.off])
        kept = [(c.buf[p:q][~gone[p:q]] if r else c.buf[p:q]).tobytes() for p, q, r in zip(c.off[:-1], c.off[1:], removed, strict=True)]
        after = np.append(gone[1:], False)
        after[c.off[1:][np.diff(c.off) > 0] - 1] = False
        base = np.repeat(c.off[:-1], spans)
        ends = [pa.array(np.flatnonzero(x) + e - base, pa.int64()) for x, e in ((gone & ~before, 0), (gone & ~after, 1))]
        lists = pa.ListArray.from_arrays(pa.array(runs[c.off], pa.int32()), pa.StructArray.from_arrays(ends, ["start", "end"]))
        return pa.table({"doc_id": docs["doc_id"], "n_bytes": np.diff(c.off), "kept": pa.array(kept, pa.binary()), "spans": lists})

    return f


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) of every row of `docs`.

    kept: the bytes that stay, binary as a removed run may split a character; spans: (start, end) of each removed run,
    in bytes of the input.
    """
    own, n = batches(docs, doc_id, text)
    first = own.groupBy("batch").applyInArrow(_ask(n, width, k), REQUEST).groupBy("bucket").applyInArrow(_judge(hot), REQUEST)
    # read twice in one plan, which deals the texts and the questions out once
    second = own.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(_send(n, width, k), REQUEST).groupBy("kind", "bucket").applyInArrow(_index(width, INDEX_BYTES, INDEX_TEXTS), REQUEST)
    out = own.groupBy("batch").cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(_remove(n, width, k), "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "spans")
