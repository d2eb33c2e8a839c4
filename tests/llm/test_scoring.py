from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.llm import op2_line_frequency as op2
from tephra.llm import op3_nearest_toxic as op3
from tephra.llm import op5_licence_digest as op5
from tephra.llm import op7_cross_entropy as op7
from tephra.llm.text import U64, mix, word_hashes
from tests.llm import brute

duckdb = pytest.importorskip("duckdb")


def _sql(df, name, sql):
    c = duckdb.connect()
    c.register(name, df.toPandas())
    return c.execute(sql).df()


def _same(got, want):
    columns = sorted(want.columns)
    key = lambda f: sorted(tuple("" if v is None or v != v else str(v).removesuffix(".0") for v in r) for r in f[columns].itertuples(index=False))
    assert key(got.toPandas()) == key(want)


def test_rules_against_sql(spark, mean_docs, sf_dir):
    docs = mean_docs.where("doc_id is not null").select("doc_id", "text", "source")
    _same(op2.line_frequency_rules(docs).drop("row", "host", "text_hash"), _sql(docs, "documents", op2.ORACLE))
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _same(op2.query(spark, sf_dir), _sql(real, "documents", op2.ORACLE))


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    menu = "HOME  About 12 contact " + " ".join(f"m{j}" for j in range(20))
    rows = [(i, f"{own(i)}\n{menu}", "a") for i in range(12)] + [(20, menu.lower().replace("12", "97") + "\nleft over", "a"), (21, menu, "b"), (22, None, "a"), (23, "", None), (None, own(99), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in op2.line_frequency_rules(docs).collect()}
    assert all(out[i].kept and out[i].n_removed_lines == 1 and out[i].n_left_words == 30 for i in range(12))
    assert not out[20].kept and not out[20].base_failed and out[21].kept and out[22].base_failed and out[None].kept
    kept = op2.keep(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(12), 21, None], key=str) and kept.columns == docs.columns


def test_repeated_windows(spark):
    words = " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(1, f"{words}\n{words}\n \n{words} \n#*x"), (2, " ".join(["z"] * 12))], "doc_id long, text string").withColumn("source", F.lit("s"))
    out = {r.doc_id: r for r in op2.line_frequency_rules(docs).collect()}
    assert (out[1].n_words, out[1].n_repeat_words, out[1].n_dup_lines, out[1].n_symbols) == (31, 30, 1, 2)
    assert out[2].n_repeat_words == 12


def test_block_max_index_is_exact():
    rng = np.random.default_rng(0)
    draw = lambda: np.sort(rng.choice(20, rng.integers(1, 6), replace=False))
    rows = [(t := draw(), rng.integers(1, 4, len(t))) for _ in range(300)]
    weight = rng.uniform(0.5, 3, 20)
    weight[3] = 0
    index = op3.BlockMaxIndex(rows, weight, block=16)
    for i in range(60):
        t = draw()
        n = rng.integers(1, 4, len(t))
        q = dict(zip(t.tolist(), index.weigh(t, n).tolist()))
        without = rng.random(300) < 0.3 if i % 2 else None
        cosine = np.round([sum(q.get(a, 0) * w for a, w in zip(r[0].tolist(), index.weigh(*r).tolist())) for r in rows], 12)
        if without is not None:
            cosine[without] = 0
        last = np.sort(cosine)[-15]
        want = np.flatnonzero((cosine > 0) & (cosine >= last))
        best, got = index.nearest(t, n, 15, without)
        assert np.allclose(np.sort(cosine[best]), np.sort(cosine[want]))
        assert np.allclose(got, cosine[best])


@pytest.mark.parametrize("most_rows", [0, 4, 512])
def test_frequent_terms_are_rows_of_a_matrix(most_rows):
    rng = np.random.default_rng(1)
    frequency = np.append([0.9] * 6, [0.02] * 94)
    draw = lambda: np.flatnonzero(rng.random(100) < frequency)
    rows = [(t := draw(), rng.integers(1, 4, len(t))) for _ in range(300)]
    queries = [(t := draw(), rng.integers(1, 4, len(t))) for _ in range(70)] + [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    index = op3.BlockMaxIndex(rows, rng.uniform(0.5, 3, 100), block=16, most_rows=most_rows)
    assert len(index.matrix) == min(6, most_rows) and len(index.example) + np.count_nonzero(index.matrix) == sum(len(t) for t, _ in rows)
    dense = np.zeros((300, 100))
    for row, (t, n) in zip(dense, rows, strict=True):
        row[t] = index.weigh(t, n)
    shares = index.shares(queries)
    for i, (t, n) in enumerate(queries):
        cosine = np.round(dense[:, t] @ index.weigh(t, n), 12)
        last = np.sort(cosine)[-15]
        best, got = index.nearest(t, n, 15, share=shares[i])
        assert set(best.tolist()) == set(np.flatnonzero((cosine > 0) & (cosine >= last)).tolist())
        assert np.allclose(got, cosine[best], atol=1e-11)
        assert np.array_equal(shares[i], index.shares([(t, n)])[0])


def _plain_scores(rows, labels, k=15):
    """Scores of rows (doc_id, text) by comparing each with every example, in plain Python; all labelled rows are examples."""
    def lower(w):
        return bytes(c + 32 if 65 <= c <= 90 else c for c in w)

    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    known = {}
    for d, y in labels:
        if d is not None and y in (0, 1) and not held(d):
            known[d] = max(known.get(d, 0), y)
    texts = [[lower(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())] for _, t in rows]
    df = Counter(w for t in texts for w in set(t))
    idf = {w: math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in df}
    examples = {d: (known[d], t) for (d, _), t in zip(rows, texts) if d in known}  # one text an id in these tables
    sketches = {tuple(t): frozenset([min(zip(t, t[1:]), key=lambda p: _pair_hash(*p))]) if len(t) > 1 else tuple(t) for _, t in examples.values()}
    sketch = lambda t: sketches[tuple(t)]
    sizes = [sum(y == c for y in known.values()) for c in (0, 1)]
    n = [sum(y == c for y, _ in examples.values()) for c in (0, 1)]
    classes = [{}, {}]
    for y, t in examples.values():
        for w in set(t):
            classes[y].setdefault(w, set()).add(sketch(t))
    q, p = (len({sketch(t) for y, t in examples.values() if y == c}) for c in (0, 1))
    z2 = {}
    for w in {*classes[0], *classes[1]}:
        a, b = len(classes[1].get(w, ())) + p / (p + q), len(classes[0].get(w, ())) + q / (p + q)
        z = (math.log(a / (p + 1)) - math.log(b / (q + 1)) - math.log(p / (p + 1)) + math.log(q / (q + 1))) / math.sqrt(1 / a + 1 / b)
        z2[w] = z * z

    def vector(t):
        w = {x: (1 + math.log(c)) * idf[x] * z2[x] for x, c in Counter(t).items() if x in z2}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / size for x, v in w.items()} if size else {}

    entries = {}
    for d, (y, t) in examples.items():
        if t:
            e = entries.setdefault(tuple(sorted(Counter(t).items())), {"v": vector(t), "s": sketch(t), "y": []})
            e["y"].append(y)
    weight = [sizes[c] / n[c] for c in (0, 1)]

    def raw(t, without=None):
        v = vector(t)
        cosine = sorted(((round(sum(x * e["v"].get(w, 0) for w, x in v.items()), 12), i) for i, e in enumerate(entries.values()) if e["s"] != without), reverse=True)
        cosine = [(c, i) for c, i in cosine if c > 0]
        if len(cosine) > k:
            cosine = [x for x in cosine if x[0] >= cosine[k - 1][0]]
        toxic = every = 0.0
        for c, i in cosine:
            ys = list(entries.values())[i]["y"]
            toxic += c * c * sum(weight[1] for y in ys if y) / len(ys)
            every += c * c * sum(weight[y] for y in ys) / len(ys)
        prior = sizes[1] / sum(sizes)
        return (toxic + op3.PRIOR * prior) / (every + op3.PRIOR)

    unaided = [(raw(t, sketch(t)), y) for y, t in examples.values()]
    a, b = op3.fitted_curve(np.array([r for r, _ in unaided]), np.array([y for _, y in unaided]), np.array([weight[y] for _, y in unaided]))
    logit = lambda x: math.log(min(max(x, 1e-3), 1 - 1e-3) / (1 - min(max(x, 1e-3), 1 - 1e-3)))
    return sorted(((d, 1 / (1 + math.exp(-(a * logit(raw(t)) + b)))) for (d, _), t in zip(rows, texts)), key=str)


@functools.cache
def _pair_hash(a, b):
    """The operator's hash of two neighbouring words, as a sketch is the least of them."""
    h = word_hashes(np.frombuffer(a + b" " + b, np.uint8), np.array([0, len(a) + 1]), np.array([len(a), len(a) + 1 + len(b)]))
    return int(mix(h[:1] * U64(3) + h[1:])[0])


def _close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6


def test_toxicity_against_all_cosines(spark, sf_dir, real_rows):
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    got = sorted(((r.doc_id, r.score) for r in op3.query(spark, sf_dir).collect()), key=str)
    _close(got, _plain_scores(real_rows, labels))


def test_toxicity_of_a_mean_table_against_all_cosines(spark, mean_rows):
    rows = [r for r in mean_rows if r[0] not in (7, 102)]  # ids with one text each
    labels = [(d, int(d % 3 == 0)) for d, _ in rows if d is not None and d % 7] + [(50, 1), (50, 0), (51, None), (None, 1), (1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash")).repartition(3)
    got = op3.nearest_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    _close(sorted(((r.doc_id, r.score) for r in got.collect()), key=str), _plain_scores(rows, labels))


def test_labelled_ids_with_several_texts_are_deterministic(spark):
    docs, labels = _toxic(spark, 200)
    more = docs.unionByName(spark.createDataFrame([(i, f"other text {i} vile") for i in range(0, 200, 3)], "doc_id long, text string"))
    a, b = ({(r.doc_id, r.score) for r in op3.nearest_toxic(x, labels).collect()} for x in (more.repartition(5), more.coalesce(1)))
    assert a == b


def _toxic(spark, n=600):
    rng = np.random.default_rng(0)
    common = [f"c{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(common, 40).tolist()
        bad = i % 8 == 0
        if bad:
            for x in rng.choice(["vile", "foul", "Nasty"], 3):
                w.insert(int(rng.integers(len(w))), str(x))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(n, None), (n + 1, ""), (None, "vile foul nasty"), (n + 2, "vile, foul! nasty"), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1), (5, 0)], "doc_id long, toxic int")


def test_toxic_documents_are_found(spark):
    docs, labels = _toxic(spark)
    out = op3.nearest_toxic(docs, labels).toPandas()
    assert len(out) == 605 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    truth = labels.where("doc_id is not null and toxic is not null").toPandas().drop_duplicates().set_index("doc_id").toxic
    held = out[out.held_out & out.doc_id.isin(truth.index)]
    assert len(held) > 80 and (held.predicted == truth.loc[held.doc_id].to_numpy()).mean() > 0.98
    last = out.set_index("doc_id")
    assert last.loc[602].predicted == 1 and len(last.loc[602].evidence) == op3.NEIGHBOURS and last.loc[600].score == last.loc[601].score < 0.5
    brier = ((held.score - truth.loc[held.doc_id].to_numpy()) ** 2).mean()
    assert brier < 0.03


def test_toxicity_without_labels(spark, mean_docs, empty_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert op3.nearest_toxic(mean_docs, labels).agg(F.max("score")).first()[0] == 0
    ones = spark.createDataFrame([(50, 1), (51, 1)], "doc_id long, toxic int")
    assert op3.nearest_toxic(mean_docs, ones).agg(F.min("score")).first()[0] >= 0
    assert op3.nearest_toxic(empty_docs, ones).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs, labels = _toxic(spark, 300)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (op3.nearest_toxic(docs, x).select("doc_id", "score").orderBy("doc_id", "score").collect() for x in (labels, turned))
    assert a == b


def test_licences(spark, empty_docs):
    known = dict(op5.known_licences())
    assert {"MIT", "ISC", "BSD-2-Clause", "Zlib"} <= set(known)
    mit = known["MIT"]
    changed = mit.upper().replace("MIT LICENSE", "MIT Licence").replace("Copyright (c) <year> <copyright holders>".upper(), "  © 2021 Some One\nCopyright 2020, 2021 Other").replace('"', "'").replace(" ", "  ")
    rows = [(1, mit), (2, changed), (3, mit + " and more"), (4, None), (5, ""), (6, "Copyright 2020 x"), (None, known["ISC"]), (2, changed), (7, mit[:200]), (8, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit("clash"))
    out = op5.licence_digests(docs)
    assert sorted(((r.doc_id, r.licence) for r in out.collect() if r.licence), key=str) == [(1, "MIT"), (2, "MIT"), (2, "MIT"), (None, "ISC")]
    assert out.count() == len(rows) and op5.licence_digests(empty_docs).count() == 0
    _same(out, _sql(docs.select("doc_id", "text"), "documents", op5.ORACLE))
    own = spark.createDataFrame([("mine", "All organisations favour this."), ("twin", "all organizations favor this")], "licence string, text string").limit(2)
    hit = spark.createDataFrame([(1, "ALL organisations: favour this")], "doc_id long, text string")
    assert op5.licence_digests(hit, own).first().licence == "mine"  # organisations is no listed spelling, so it is no twin
    assert op5.licence_digests(spark.createDataFrame([(1, "all organizations FAVOUR this")], "doc_id long, text string"), own).first().licence == "twin"


def test_cross_entropy_against_a_plain_model(spark, mean_docs, mean_rows, empty_docs):
    rows = [r for r in mean_rows if r[1] is None or len(r[1]) < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(50, 1), (51, 1), (52, 0), (10, 1), (10, 0), (None, 1), (11, None), (7, 1)], "doc_id long, quality int")
    got = sorted(((r.doc_id, r.n_words, r.target_bits, r.background_bits) for r in op7.cross_entropy_difference(docs, labels).collect()), key=str)
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute.losses(rows, {50, 51, 10, 7}))), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[1], str(r[2])[:6])), sorted(want, key=lambda r: (str(r[0]), r[1], str(r[2])[:6]))):
        assert a[:2] == b[:2]
        assert a[2:] == b[2:] if b[2] is None else np.allclose(a[2:], b[2:])
    assert op7.cross_entropy_difference(empty_docs, labels).count() == 0
    assert op7.cross_entropy_difference(docs, labels.limit(0)).where("score is null").count() == 4


def test_target_like_documents_score_lower(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice([f"{'t' if i % 2 else 'b'}{j}" for j in range(40)], 60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 40, 2)], "doc_id long, quality int")
    out = op7.cross_entropy_difference(docs, labels).toPandas()
    assert out[out.doc_id % 2 == 1].score.max() < out[out.doc_id % 2 == 0].score.min()
