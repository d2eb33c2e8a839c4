"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples. Of the labelled rows that aren't held out, `examples` of each class in the order of a hash, as long as their
texts together are within `example_bytes`: these two parameters bound what is fitted; nothing else is sampled. Every
word of an example (runs of letters, digits and bytes over 0x7F, A-Z as a-z) is a term of the index. Examples with the
same words and counts are one entry with its labels counted.

Weights. A term's weight in a text is (1 + ln count) * idf * z ** 2. idf = ln((1 + N) / (1 + df)) + 1 is counted over all
documents; z is how far, in standard errors, the log odds of the term differ between the classes of the examples, where
near copies (equal sketches) count once. A word that no example has has z = 0, so norms over the index's terms are whole.

Scoring. Each document is a query. For each term the index has the blocks of entries that hold it, with the largest
weight in the block; their sum bounds the cosine of any entry of a block. Blocks are opened in falling order of their
bound until it can't reach the k-th best cosine, so the nearest are exact; entries that tie with the k-th (to 12 digits)
all vote. The lists of the terms that most entries share are whole rows of a matrix: their part of every cosine is one
product for many documents, known before a block is opened, and the bound of a block adds the other terms to it.
An entry votes with the square of its cosine, weighted back to the class sizes from which examples were taken,
against a prior worth PRIOR votes. A logistic curve turns the share of toxic votes into the score; it is fitted to the
examples themselves, each scored without the entries of its sketch, and held near the identity by RIDGE.
`evidence` holds the ids of up to k nearest entries (the smallest id of each entry).

Null and empty texts have no term and score what the prior does. Labels are read by doc_id alone: rows that repeat a
doc_id count once, toxic if any says so; where a labelled doc_id has several texts, that of the least hash is the
example. Null labels and ids are ignored. Without labels of both classes the score is the share of toxic labels, 0 if
there are none. Rows that repeat a document are scored each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tephra.llm.hashing import text_hash
from tephra.llm.shared import folder, spread
from tephra.llm.text import LOWER, U64, chunks, mix, utf8, word_hashes

EXAMPLES, EXAMPLE_BYTES = 2000, 64 << 20
NEIGHBOURS, PRIOR, BLOCK, RIDGE = 15, 0.25, 64, 4.0
#: Distinct vectors whose scores a task remembers, for texts that recur.
REMEMBERED = 4096
#: Terms with rows of their own at most, their least share of entries, and documents of one product with these rows.
ROWS, SHARED, TOGETHER = 512, 1 / 16, 64

BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of its document."""
    if not len(buf):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    gap = BREAK[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = gap[:-1]
    edge[off] = True
    start = np.flatnonzero(edge[:-1] & ~gap)
    edge[1:-1] = gap[1:]
    edge[off] = True
    end = np.flatnonzero(edge[1:] & ~gap) + 1
    return word_hashes(LOWER[buf], start, end), np.searchsorted(off, start, "right") - 1


def sketches(term: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Of each document the least hash of two neighbouring words (of its word, if it has one; 0 if it has none)."""
    out = np.full(n, ~U64(0))
    pair = mix(term[:-1] * U64(3) + term[1:])
    same = of[:-1] == of[1:]
    np.minimum.at(out, of[:-1][same], pair[same])
    size = np.bincount(of, minlength=n)
    out[size == 0] = 0
    one = size[of] == 1
    out[of[one]] = term[one]
    return out


def _counts(term: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each distinct pair, in order."""
    distinct, at = np.unique(term, return_inverse=True)
    key, count = np.unique(of * np.int64(max(1, len(distinct))) + at, return_counts=True)
    return key // max(1, len(distinct)), distinct[key % max(1, len(distinct))], count


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, its first row, document, term, count, sketch) of chunks of each batch."""
    for batch in batches:
        buf, off = utf8(batch["text"])
        for i, j in chunks(off):
            term, of = _terms(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield batch, i, *_counts(term, of), sketches(term, of, j - i)


EXAMPLE = "doc_id long, toxic int, sketch long, terms binary, counts binary"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, doc, term, count, sketch in _vectors(batches):
        cut = np.searchsorted(doc, np.arange(len(sketch) + 1))
        packed = [[v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for v in (term, count.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, len(sketch)), batch["toxic"].slice(i, len(sketch)), pa.array(sketch.view(np.int64)), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], [c.split()[0] for c in EXAMPLE.split(", ")])


def _known(term: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each term among the index's sorted `terms`, and whether it is one of them."""
    at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
    return at, (terms[at] == term) if len(terms) else np.zeros(len(term), bool)


def _frequencies(terms: np.ndarray) -> Callable:
    """(term, n): in how many documents of the partition each term is; the number of documents under -1."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for _, _, _, term, _, sketch in _vectors(batches):
            distinct, times = np.unique(term, return_counts=True)
            at, hit = _known(distinct, terms)
            total[at[hit]] += times[hit]
            n += len(sketch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], n))], ["term", "n"])

    return f


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class BlockMaxIndex:
    """Inverted lists of weighted entries, by term and block, with the largest weight of each term in each block.

    Lists of frequent terms are rows of a matrix.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, block: int = BLOCK, most_rows: int = ROWS):
        """rows: (terms, counts) of each entry, terms in order; weight: of each term, beside its count."""
        self.term_weight, self.block, self.n = weight, block, len(rows)
        weights = [self.weigh(t, c) for t, c in rows]
        # entries of one leading term stand together, so that few blocks have large weights of a term
        lead = np.array([t[np.argmax(w)] if len(t) else -1 for (t, _), w in zip(rows, weights, strict=True)], np.int64)
        self.row = np.argsort(lead, kind="stable")
        sizes = np.array([len(rows[i][0]) for i in self.row], np.int64)
        cat = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
        term, w = cat([rows[i][0] for i in self.row], np.int64).astype(np.int64), cat([weights[i] for i in self.row], float)
        example = np.repeat(np.arange(self.n), sizes)
        self.n_blocks = -(-self.n // block)
        df = np.bincount(term, minlength=len(weight))
        often = np.argsort(-df, kind="stable")[:most_rows]
        often = often[df[often] >= max(1, self.n * SHARED)]
        self.place = np.full(len(weight), -1)
        self.place[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.n_blocks * block))
        at = self.place[term]
        self.matrix[at[at >= 0], example[at >= 0]] = w[at >= 0]
        term, example, w = term[at < 0], example[at < 0], w[at < 0]
        by = np.lexsort((example, term))
        term, self.example, self.weight = term[by], example[by], w[by]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (self.example[1:] // block != self.example[:-1] // block)
        first = np.flatnonzero(new)
        self.post = np.append(first, len(term))
        self.entry_block = self.example[first] // block
        self.entry_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry = np.searchsorted(term[first], np.arange(len(weight) + 1))

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.term_weight[terms]
        size = np.sqrt((w * w).sum())
        return w / size if size > 0 else w

    def shares(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The part of every entry's cosine that the matrix gives, a row for each query.

        Products have one shape, whatever the number of queries, so that a query's sums don't depend on the others.
        """
        out = np.zeros((-(-len(queries) // TOGETHER) * TOGETHER, self.matrix.shape[1]))
        if not len(self.matrix):
            return out
        for i in range(0, len(out), TOGETHER):
            weights = np.zeros((TOGETHER, len(self.matrix)))
            for row, (terms, counts) in zip(weights, queries[i : i + TOGETHER], strict=False):
                at = self.place[terms]
                row[at[at >= 0]] = self.weigh(terms, counts)[at >= 0]
            np.matmul(weights, self.matrix, out=out[i : i + TOGETHER])
        return out

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, without: np.ndarray | None = None, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k entries of largest cosine above 0, and all that tie with the last, with their cosines.

        without: rows that don't count; share: the query's row of `shares`.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms) or not self.n:
            return none
        if share is None:
            share = self.shares([(terms, counts)])[0]
        q, listed = self.weigh(terms, counts), self.place[terms] < 0
        terms, q = terms[listed], q[listed]
        count = self.entry[terms + 1] - self.entry[terms]
        entry, weight = _spread(self.entry[terms], count), np.repeat(q, count)
        block = self.entry_block[entry]
        bound = np.bincount(block, weight * self.entry_most[entry], minlength=self.n_blocks) + share.reshape(self.n_blocks, self.block).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, cosine, i = *none, 0
        for step in (4, 16, len(order)):
            least = cosine[k - 1] if len(best) >= k else 0.0
            waiting = order[i : i + step]
            waiting = waiting[bound[waiting] >= least - 1e-9]  # the others, and all after them, can't reach the k-th
            if not len(waiting):
                break
            opened = np.zeros(self.n_blocks, bool)
            opened[waiting] = True
            some = np.flatnonzero(opened[block])
            first = self.post[entry[some]]
            size = self.post[entry[some] + 1] - first
            post = _spread(first, size)
            found = np.bincount(self.example[post], np.repeat(weight[some], size) * self.weight[post], minlength=len(share))
            found = np.where(np.repeat(opened, self.block), found + share, 0.0)[: self.n]
            if without is not None:
                found[without[self.row]] = 0
            hit = np.flatnonzero(found >= max(least - 1e-9, 1e-12))
            best, cosine = np.concatenate([best, hit]), np.concatenate([cosine, np.round(found[hit], 12)])
            if len(best) > k:
                some = np.flatnonzero(cosine >= np.partition(cosine, -k)[-k])
                best, cosine = best[some], cosine[some]
            top = np.argsort(-cosine, kind="stable")
            best, cosine, i = best[top], cosine[top], i + step
        return self.row[best], cosine


def odds_weight(a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """z ** 2 of terms in a of p toxic and b of q other texts; one text shared out by class sizes keeps counts off 0."""
    a, b = a + p / (p + q), b + q / (p + q)
    z = (np.log(a / (p + 1)) - np.log(b / (q + 1)) - np.log(p / (p + 1)) + np.log(q / (q + 1))) / np.sqrt(1 / a + 1 / b)
    return z * z


@dataclass
class Model:
    """What a score is made of: terms, their weights, and entries with their votes. Tasks get it as one broadcast."""

    terms: np.ndarray
    index: BlockMaxIndex
    votes: np.ndarray  # of each entry: weight of its toxic labels, of all its labels
    ids: np.ndarray
    near: np.ndarray  # entries with a sketch, in order of sketch
    near_sketch: np.ndarray
    prior: float

    def raws(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> Iterator[tuple[float, list[int]]]:
        """Of each row what `raw` gives."""
        for i in range(0, len(rows), TOGETHER):
            some = rows[i : i + TOGETHER]
            for j, ((terms, counts), share) in enumerate(zip(some, self.index.shares(some), strict=False), i):
                yield self.raw(terms, counts, k, None if without is None else without[j], share)

    def raw(self, terms: np.ndarray, counts: np.ndarray, k: int, without: int | None = None, share: np.ndarray | None = None) -> tuple[float, list[int]]:
        skip = None
        if without is not None:
            skip = np.zeros(self.index.n, bool)
            skip[self.near[slice(*np.searchsorted(self.near_sketch, [without, without + 1]))]] = True
        best, cosine = self.index.nearest(terms, counts, k, skip, share)
        square = cosine * cosine
        toxic, every = (square @ self.votes[best]).tolist() if len(best) else (0.0, 0.0)
        by = np.lexsort((self.ids[best], -cosine))[:k]
        return (toxic + PRIOR * self.prior) / (every + PRIOR), self.ids[best][by].tolist()


def _logit(raw) -> np.ndarray:
    p = np.clip(raw, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _curved(raw: float, curve: tuple[float, float] | None) -> float:
    return raw if curve is None else float(1 / (1 + np.exp(-(curve[0] * _logit(raw) + curve[1]))))


def fitted_curve(raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the logit of raw scores, by Newton's method, pulled to (1, 0)."""
    x = np.column_stack([_logit(raw), np.ones(len(raw))])
    home, at = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + RIDGE * (at - home)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
        at = at - np.linalg.solve(bend, slope)
        at[0] = max(at[0], 0.05)  # a larger share of toxic votes never scores less
    return float(at[0]), float(at[1])


def _rows(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    for batch, i, doc, term, count, sketch in _vectors(batches):
        at, hit = _known(term, model.terms)
        doc, at, count = doc[hit], at[hit], count[hit]
        cut = np.searchsorted(doc, np.arange(len(sketch) + 1))
        yield batch, i, [(at[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], sketch


def _scored(shared: Broadcast[Model], curve: tuple[float, float] | None, k: int) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen: dict[bytes, tuple[float, list[int]]] = {}
        for batch, i, rows, _ in _rows(model, batches):
            keys = [terms.tobytes() + counts.tobytes() for terms, counts in rows]
            if len(seen) >= REMEMBERED:
                seen.clear()
            new = {key: row for key, row in zip(keys, rows, strict=True) if key not in seen}
            for key, (raw, evidence) in zip(new, model.raws(list(new.values()), k), strict=True):
                seen[key] = _curved(raw, curve), evidence
            out = [seen[key] for key in keys]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, len(out)), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return f


def _unaided(shared: Broadcast[Model], k: int) -> Callable:
    """Raw score of each example without the entries of its sketch."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, i, rows, sketch in _rows(model, batches):
            raw = [r for r, _ in model.raws(rows, k, sketch.view(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays([batch["toxic"].slice(i, len(raw)), pa.array(raw, pa.float64())], ["toxic", "raw"])

    return f


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _taken(own: DataFrame, known: DataFrame, examples: int, example_bytes: int) -> DataFrame:
    """(doc_id, toxic, text) of the examples, written once."""
    taken = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for c in (0, 1)]
    taken = F.broadcast(taken[0].unionByName(taken[1]))  # at most 2 * examples rows of two numbers
    one = own.join(taken, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(text_hash(F.col("text")).alias("h"), F.col("text"))).alias("x"))
    w = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # at most `examples` rows each
    within = one.select("doc_id", "toxic", "x.text").withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(w)).where(F.col("bytes") <= example_bytes)
    return within.repartition(16, "doc_id").select("doc_id", "toxic", "text").checkpoint()


def fit(own: DataFrame, known: DataFrame, examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES, k: int = NEIGHBOURS) -> tuple[Broadcast[Model], tuple[float, float] | None]:
    """The model and the curve from its votes to scores. own: (doc_id, text); known: (doc_id, toxic) to learn from, each id once.

    The model's size is bounded by the examples, so it is broadcast.
    """
    context = own.sparkSession.sparkContext
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    taken = _taken(own, known, examples, example_bytes)
    rows = sorted(taken.mapInArrow(_examples, EXAMPLE).collect(), key=lambda r: (r["toxic"], r["doc_id"]))  # the examples
    n = [sum(r["toxic"] == c for r in rows) for c in (0, 1)]
    empty = Model(np.zeros(0, U64), BlockMaxIndex([], np.zeros(0)), np.zeros((0, 2)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), share)
    if not min(n):
        return context.broadcast(empty), None
    weight = [sizes[c] / n[c] for c in (0, 1)]
    vectors = [(np.frombuffer(r["terms"], U64), np.frombuffer(r["counts"], np.int32)) for r in rows]
    terms, place = np.unique(np.concatenate([t for t, _ in vectors]), return_inverse=True)
    if not len(terms):
        return context.broadcast(empty), None
    # each sketch counts once for a term in its class
    sketch = np.array([r["sketch"] for r in rows], np.int64)
    toxic = np.array([r["toxic"] for r in rows])
    number = np.unique(sketch, return_inverse=True)[1]
    of = np.repeat(np.arange(len(rows)), [len(t) for t, _ in vectors])
    having = []
    for c in (1, 0):
        mine = toxic[of] == c
        distinct = np.unique(place[mine] * np.int64(len(rows)) + number[of[mine]]) // len(rows)
        having += [np.bincount(distinct, minlength=len(terms)), len(np.unique(number[toxic == c]))]
    counted = own.mapInArrow(_frequencies(terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    at, times = counted["term"].to_numpy(), counted["n"].to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[at[at >= 0]] = times[at >= 0]
    idf = np.log((1 + times[at < 0].sum()) / (1 + df)) + 1
    cut = np.searchsorted(of, np.arange(len(rows) + 1))
    entries: dict[bytes, int] = {}
    indexed, votes, ids, near = [], [], [], []
    for i, r in enumerate(rows):
        if cut[i] == cut[i + 1]:
            continue
        key = r["terms"] + r["counts"]
        if key not in entries:
            entries[key] = len(indexed)
            indexed.append((place[cut[i] : cut[i + 1]], vectors[i][1]))
            votes.append([0.0, 0.0, 0])
            ids.append(r["doc_id"])
        e = entries[key]
        votes[e] = [votes[e][0] + weight[1] * r["toxic"], votes[e][1] + weight[r["toxic"]], votes[e][2] + 1]
        ids[e] = min(ids[e], r["doc_id"])
        near.append((r["sketch"], e))
    votes = np.array(votes)
    index = BlockMaxIndex(indexed, idf * odds_weight(having[0], having[2], having[1], having[3]))
    near = np.array(sorted(set(near)), np.int64)
    model = Model(terms, index, votes[:, :2] / votes[:, 2:], np.array(ids, np.int64), near[:, 1], near[:, 0], share)
    del rows, vectors, indexed, place, of  # the index has what is needed of them
    shared = context.broadcast(model)
    unaided = taken.mapInArrow(_unaided(shared, k), "toxic int, raw double").collect()  # a row an example
    return shared, fitted_curve(np.array([r["raw"] for r in unaided]), np.array([r["toxic"] for r in unaided]), np.array([weight[r["toxic"]] for r in unaided]))


def nearest_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of `docs`."""
    folder(docs.sparkSession)
    own = spread(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shared, curve = fit(own, known, examples, example_bytes, k)
    scored = own.mapInArrow(_scored(shared, curve, k), "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_toxic(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
