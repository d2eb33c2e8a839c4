"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct 3-word shingles (A-Z as a-z); fewer words are one shingle. Two documents link when
100 * |intersection| >= percent * |union|. Sets are compared as 64-bit hashes of shingles.

1. Equal sets form a class; one document of each class goes on.
2. The frequency class of each shingle (the bit length of its number of classes) is counted over all classes, through
   buckets of hashes (see `exchange`): a frequent shingle reaches its bucket once from each batch.
3. Sets are ordered from rare to frequent shingles. Linked sets share at least two shingles of their extended
   prefixes (n - ceil(t * n) + 2 shingles), so it is enough to index each rare shingle there and, of the frequent
   ones, each pair. Shingles that occur in one class only are indexed by nobody. A set with more than PAIRED frequent
   shingles in its prefix would have too many pairs: it indexes them singly, and the sets that index pairs can be
   found by it under single shingles too. Of two sets the smaller meets the other within a shorter prefix
   (n - ceil(2 * t / (1 + t) * n) + 2), so keys beyond that count for the larger one only.
   A shingle of one class is in no intersection either, so the number of the others bounds what a pair can reach.
4. Every indexed key is first joined with one pivot class, not with all pairs; links found make components. Only
   classes of one key that aren't yet in one component are then joined with each other. Every candidate pair is
   verified on whole sets, and no link between components can be missed: a pair that was not verified already is
   in one component.

Null or empty texts, and texts without words, have n_shingles 0 and link with nothing: component_id is their doc_id.
Rows with a null doc_id get their n_shingles and a null component_id, and link with nothing. Repeated rows are equal
sets. Rows of one doc_id with different texts are different sets; each gets the component of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.components import components
from tephra.llm.exchange import batches, slices
from tephra.llm.hashing import text_hash
from tephra.llm.text import U64, Hashes, chunks, mix, planes, tokens, unplanes, utf8

WORDS, PERCENT = 3, 90
#: Classes of a shingle from which it counts as frequent, as a bit length (7: 64 classes), and frequent shingles of a prefix up to which pairs are indexed.
FREQUENT, PAIRED = 7, 16
#: Turns in which each key tries one pivot before the classes that are still apart meet.
PIVOTS = 2
#: Length of a prefix up to which it goes along to where classes of one key meet, to leave out most pairs there.
CARRIED = 256


def shingle_sets(buf: np.ndarray, off: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    out = []
    for i, j in chunks(off, 4 << 20):
        _, _, word, of = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        h = Hashes(word)
        gram = h.every(n_words)
        short = h.of(of[:-1], of[1:])
        for d, (a, b) in enumerate(zip(of[:-1], of[1:], strict=True)):
            s = np.sort(gram[a : b - n_words + 1]) if b - a >= n_words else short[d : d + (b > a)]
            out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s)
    return out


def _node(s: np.ndarray) -> int:
    """One hash of a set, whatever the order of its members."""
    if not len(s):
        return 0
    sums = np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), len(s)], U64)
    return int(mix(sums * np.array([1, 3, 5], U64)).sum(dtype=U64).view(np.int64))


INFO = "batch int, doc_id long, text_hash long, n_shingles long, node long"


def _info(n_words: int):
    def f(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            buf, off = utf8(batch["text"])
            sets = shingle_sets(buf, off, n_words)
            yield pa.RecordBatch.from_arrays([batch["batch"], batch["doc_id"], batch["text_hash"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64())], ["batch", "doc_id", "text_hash", "n_shingles", "node"])

    return f


def _classes(docs: pa.Table, ids: np.ndarray, nodes: np.ndarray, n_words: int) -> list[tuple[int, np.ndarray]]:
    """(node, set) of the classes that the batch speaks for."""
    own = docs.filter(pa.array(np.isin(docs["doc_id"].combine_chunks().fill_null(-1).to_numpy(), ids)))
    want = set(zip(ids.tolist(), nodes.tolist(), strict=True))
    out = []
    for doc, s in zip(own["doc_id"].to_pylist(), shingle_sets(*utf8(own["text"]), n_words), strict=True):
        if (key := (doc, _node(s))) in want:
            want.discard(key)
            out.append((key[1], s))
    return sorted(out, key=lambda x: x[0])


REQUEST = "bucket int, batch int, data binary"


def _reply(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, batch, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "batch": pa.array(batch, pa.int32()), "data": pa.array(data, pa.binary())})


def _census(sets: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of each shingle of the batch, sorted, with its number of classes."""
    every = np.concatenate([s for _, s in sets]) if sets else np.zeros(0, U64)
    return np.unique(every >> U64(16), return_counts=True)


def _ids(reps: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(reps[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "node"))


def _ask(n: int, n_words: int):
    def f(docs: pa.Table, reps: pa.Table) -> pa.Table:
        if not docs.num_rows or not reps.num_rows:
            return _reply([])
        keys, count = _census(_classes(docs, *_ids(reps), n_words))
        batch = docs["batch"][0].as_py()
        return _reply([(b, batch, planes(np.diff(keys[i:j], prepend=U64(0))) + np.minimum(count[i:j], 255).astype(np.uint8).tobytes()) for b, i, j in slices(keys << U64(16), n)])

    return f


def _count(table: pa.Table) -> pa.Table:
    bucket, batch, data = table["bucket"][0].as_py(), table["batch"].to_pylist(), table["data"].to_pylist()
    sizes = [len(d) // 9 for d in data]
    keys = np.concatenate([np.cumsum(unplanes(d[: 8 * m], U64), dtype=U64) for d, m in zip(data, sizes, strict=True)])
    count = np.concatenate([np.frombuffer(d[8 * m :], np.uint8) for d, m in zip(data, sizes, strict=True)])
    _, inv = np.unique(keys, return_inverse=True)
    bits = np.frexp(np.bincount(inv, count))[1].astype(np.uint8)[inv]
    cut = np.cumsum([0, *sizes])
    return _reply([(bucket, b, bits[i:j].tobytes()) for b, i, j in zip(batch, cut[:-1], cut[1:], strict=True)])


INDEXED = "node long, n int, shared int, keys array<long>, kinds array<byte>, brief array<boolean>, single boolean, prefix array<long>, beyond int, members array<long>"


def _index(n: int, n_words: int, percent: int, frequent: int, paired: int):
    def f(docs: pa.Table, right: pa.Table) -> pa.Table:
        reps = right.filter(pa.compute.is_valid(right["node"]))
        sets = _classes(docs, *_ids(reps), n_words) if docs.num_rows and reps.num_rows else []
        keys, _ = _census(sets)
        answers = right.filter(pa.compute.is_valid(right["data"]))
        answers = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True))
        bits = np.empty(len(keys), np.uint8)
        for b, i, j in slices(keys << U64(16), n):
            bits[i:j] = np.frombuffer(answers[b], np.uint8)
        rows = []
        for node, s in sets:
            size = len(s)
            of = bits_of = bits[np.searchsorted(keys, s >> U64(16))]
            prefix = size + (-percent * size) // 100 + 2
            if (of == 1).sum() >= prefix:
                continue  # shared by nobody as far as the prefix goes
            first = np.lexsort((s, of))[:prefix]
            t, of = s[first], of[first]
            # a set that is no larger than its partner shares two shingles within this shorter prefix of its own
            brief = np.arange(prefix) < size + (-2 * percent * size) // (100 + percent) + 2
            at_rare, at_common = np.flatnonzero((of > 1) & (of < frequent)), np.flatnonzero(of >= frequent)
            common = t[at_common]
            key, kind, short, single = [mix(t[at_rare])], [np.zeros(len(at_rare), np.int8)], [brief[at_rare]], len(common) > paired
            if len(common) > 1:
                if not single:
                    a, b = np.triu_indices(len(common), 1)
                    key.append(mix(common[a] * U64(0x9E3779B97F4A7C15) ^ mix(common[b])))
                    kind.append(np.zeros(len(a), np.int8))
                    short.append(brief[at_common[b]])
                key.append(mix(common))
                kind.append(np.ones(len(common), np.int8))
                short.append(brief[at_common])
            key, kind, short = np.concatenate(key), np.concatenate(kind), np.concatenate(short)
            if len(key):
                rows.append((node, size, int((bits_of > 1).sum()), key.view(np.int64), kind, short, single, t[of > 1].view(np.int64) if prefix <= CARRIED else None, size - prefix, s.view(np.int64)))
        node, size, shared, key, kind, short, single, before, beyond, members = zip(*rows, strict=True) if rows else ((),) * 10
        lists = lambda v, t: pa.array(list(v), pa.list_(t))
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(size, pa.int32()), "shared": pa.array(shared, pa.int32()), "keys": lists(key, pa.int64()), "kinds": lists(kind, pa.int8()), "brief": lists(short, pa.bool_()), "single": pa.array(single, pa.bool_()), "prefix": lists(before, pa.int64()), "beyond": pa.array(beyond, pa.int32()), "members": lists(members, pa.int64())})

    return f


def _fits(n: str, shared: str, m: str, shared_m: str, percent: int):
    """Sets that can link by their sizes: shingles that no other class has are in no intersection."""
    both = F.least(shared, shared_m)
    return both * 100 >= (F.col(n) + F.col(m) - both) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    either = F.size("set_u") + F.size("set_v") - both
    return pairs.join(side("u"), "u").join(side("v"), "v").where(both * 100 >= either * percent).select("u", "v").checkpoint()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, n_words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, paired: int = PAIRED) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, text_hash, root) of every row of `docs`; node: hash of its set, root: least node of its component."""
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and 100 at most")
    own, n = batches(docs, doc_id, text, salted=False)  # several jobs deal them out, and must do so alike
    info = own.withColumn("text_hash", text_hash(F.col("text"))).mapInArrow(_info(n_words), INFO).checkpoint()
    known = info.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    own = own.where(F.col("doc_id").isNotNull())  # no other row speaks for a class
    classes = known.groupBy("node").agg(F.min(F.struct("doc_id", "batch")).alias("first"), F.max("n_shingles").alias("n")).select("node", "n", "first.doc_id", "first.batch").checkpoint()
    # smaller sets link with equal ones only: a set of n and one of n + 1 share n of n + 1 at most
    reps = classes.where(F.col("n") * (100 - percent) >= percent).select("batch", "doc_id", "node")
    answers = own.groupBy("batch").cogroup(reps.groupBy("batch")).applyInArrow(_ask(n, n_words), REQUEST).groupBy("bucket").applyInArrow(_count, REQUEST)
    right = answers.unionByName(reps, allowMissingColumns=True)
    indexed = own.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(_index(n, n_words, percent, frequent, paired), INDEXED).checkpoint()
    sets = indexed.select("node", "members")
    listed = indexed.select("node", "n", "shared", "single", F.explode(F.arrays_zip("keys", "kinds", "brief")).alias("x")).select("node", "n", "shared", "single", F.col("x.keys").alias("key"), F.col("x.kinds").alias("kind"), F.col("x.brief").alias("brief"))

    # under single shingles, sets that index pairs need only meet those that don't
    leads = (F.col("kind") == 0) | F.col("single")
    fits = _fits("n", "shared", "m", "shared_m", percent)
    # what is counted by key is written before it is joined, so that a key with many rows can be split in the join
    shown = listed.groupBy("key", "kind").agg(F.count("*").alias("c"), F.max(leads).alias("led"), F.max("brief").alias("short")).where((F.col("c") > 1) & F.col("led") & F.col("short")).select("key", "kind").checkpoint()
    met = listed.join(shown, ["key", "kind"]).checkpoint()
    links, tried, apart = None, None, met.withColumn("root", F.col("node"))
    for turn in range(PIVOTS):
        # near copies are nearest to the text they were made from, which has the fewest shingles of its own
        order = F.struct(F.col("n") - F.col("shared"), F.xxhash64("node", F.lit(turn)))
        pivot = F.min(F.when(leads, F.struct(order.alias("o"), F.col("node").alias("v"), F.col("n").alias("m"), F.col("shared").alias("shared_m"), F.col("root").alias("root_v")))).alias("pivot")
        pivots = apart.groupBy("key", "kind").agg(pivot).select("key", "kind", "pivot.*").drop("o").checkpoint()
        stars = apart.join(pivots, ["key", "kind"]).where((F.col("root") != F.col("root_v")) & fits).select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()
        if tried is not None:
            stars = stars.join(tried, ["u", "v"], "left_anti")
        stars = stars.checkpoint()
        found = _verified(stars, sets, percent)
        links, tried = (found, stars) if links is None else (links.unionByName(found), tried.unionByName(stars))
        root = components(links)
        # keys whose classes are not all in one component yet
        placed = met.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = placed.groupBy("key", "kind").agg(F.min("root").alias("a"), F.max("root").alias("b")).where(F.col("a") != F.col("b")).select("key", "kind").checkpoint()
        apart = placed.join(split, ["key", "kind"]).checkpoint()

    # shingles in both sets are in both prefixes, or beyond the prefix that ends first
    apart = apart.join(indexed.select("node", "prefix", "beyond"), "node")
    other = apart.select("key", "kind", F.col("single").alias("single_v"), F.col("node").alias("v"), F.col("n").alias("m"), F.col("shared").alias("shared_m"), F.col("brief").alias("brief_v"), F.col("root").alias("root_v"), F.col("prefix").alias("prefix_v"), F.col("beyond").alias("beyond_v"))
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("v")))
    meets = (F.col("node") > F.col("v")) & (F.col("root") != F.col("root_v")) & ((F.col("kind") == 0) | F.col("single") | F.col("single_v")) & F.when(smaller, F.col("brief")).otherwise(F.col("brief_v"))
    reach = F.when(F.col("prefix").isNull() | F.col("prefix_v").isNull(), F.least("n", "m")).otherwise(F.size(F.array_intersect("prefix", "prefix_v")) + F.greatest("beyond", "beyond_v"))
    meets &= reach * 100 >= (F.col("n") + F.col("m") - reach) * percent
    rest = apart.join(other, ["key", "kind"]).where(meets & fits).select(F.col("node").alias("u"), "v").distinct().join(tried, ["u", "v"], "left_anti").checkpoint()
    root = components(links.unionByName(_verified(rest, sets, percent)))

    member = classes.join(root, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = member.join(smallest, "root").select("node", "component_id", "root")
    joined = known.join(of_class, "node").select("doc_id", "n_shingles", "component_id", "node", "text_hash", "root")
    rest_of = info.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node", "text_hash", F.col("node").alias("root"))
    return joined.unionByName(rest_of)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "text_hash", "root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, by: str = "component_id", **how) -> DataFrame:
    """One row of each component, that of its smallest doc_id, with all columns; rows that link with nothing stay.

    Rows with a null doc_id, and texts without words, all stay; of rows that repeat an id and its text, one does.
    Where an id is used again for another text, two components can have one smallest doc_id: `by` "root" keeps a row of
    each, `by` "component_id" one row of that id.
    """
    of = jaccard_components(docs, doc_id, text, **how)
    first = of.where((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy(by).agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__hash"))
    alone = of.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    keys = first.withColumn("__one", F.lit(True)).unionByName(alone.withColumn("__one", F.lit(False)))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (text_hash(F.col(text)) == F.col("__hash"))
    met = docs.join(keys, same)
    return met.where("__one").dropDuplicates(["__id", "__hash"]).unionByName(met.where("NOT __one")).select(*[F.col(f"`{c}`") for c in docs.columns])
