from __future__ import annotations

import random

import numpy as np
import pytest

from tephra.llm import op1_suffix_dedup as op1
from tephra.llm import op4_seed_extend as op4
from tephra.llm import op10_jaccard_join as op10
from tephra.llm.components import components
from tephra.llm.runindex import RunIndex
from tests.llm import brute


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def test_run_index_against_brute_force():
    rng = random.Random(0)
    for width in (3, 7):
        for _ in range(30):
            texts = ["".join(rng.choice("ab") for _ in range(rng.randint(width, 3 * width))) for _ in range(rng.randint(1, 8))]
            texts += texts[:1]
            index = RunIndex(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]), width)
            every = [(i, s, texts[i][s:]) for i in range(len(texts)) for s in range(len(texts[i]) - width + 1)]

            def common(a, b):
                k = 0
                while k < min(len(a), len(b)) and a[k] == b[k]:
                    k += 1
                return k

            want = [max((common(t, u) for j, q, u in every if (j, q) != (i, s)), default=0) for i, s, t in every]
            # below the width a match may run out of the starts that count; from the width on it is exact
            got = index.matching_statistics().tolist()
            assert [max(v, width - 1) for v in got] == [max(v, width - 1) for v in want]
            assert index.repeated().tolist() == [v >= width for v in want]
            assert index.run_lengths.sum() == len(every) and len(index.run_symbols) <= len(every)


OP1 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [1, 3, 512])
def test_suffix_dedup(mean_docs, mean_rows, hot):
    assert _rows(op1.suffix_dedup(mean_docs, hot=hot), *OP1) == brute.suffix_dedup(mean_rows)


def test_suffix_dedup_narrow(mean_docs, mean_rows):
    assert _rows(op1.suffix_dedup(mean_docs, width=24, k=8, hot=4), *OP1) == brute.suffix_dedup(mean_rows, 24)


def test_suffix_dedup_real(spark, sf_dir, real_rows):
    assert _rows(op1.query(spark, sf_dir), *OP1) == brute.suffix_dedup(real_rows)


OP4 = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("width, k, hot", [(13, 5, 512), (13, 5, 3), (5, 2, 512), (3, 3, 512)])
def test_seed_extend(mean_docs, mean_rows, width, k, hot):
    out = op4.seed_extend_dedup(mean_docs, width=width, k=k, hot=hot)
    assert _rows(out, *OP4) == brute.seed_extend(mean_rows, width)
    texts = {}
    for d, t in mean_rows:
        texts.setdefault(d, []).append(brute.words(t))
    windows = {d: {tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1)} for d, ws in texts.items()}
    for r in out.collect():
        for x in r.spans:
            assert x.end - x.start >= width and x.other < r.doc_id
            assert any(tuple(w[x.start : x.start + width]) in windows[x.other] for w in texts[r.doc_id])


def test_contexts_extend_both_ways():
    # two contexts agree with the first to the left of the seed, and one to the right
    words = np.array([1, 2, 9, 9, 3, 4, 1, 2, 9, 9, 3, 5, 7, 2, 9, 9, 3, 4], np.uint64)
    got = op4.extended(np.array([10, 11, 12]), np.array([2, 2, 2]), np.array([6, 6, 6]), words, 5, 2)
    assert got.tolist() == [10, 10, 10, 11, 12, 10]


def test_seed_extend_real(spark, sf_dir, real_rows):
    assert _rows(op4.query(spark, sf_dir), *OP4) == brute.seed_extend(real_rows)


OP10 = ("doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize("frequent, paired", [(7, 16), (2, 16), (2, 1), (3, 4)])
def test_jaccard(mean_docs, mean_rows, frequent, paired):
    assert _rows(op10.jaccard_components(mean_docs, frequent=frequent, paired=paired), *OP10) == brute.jaccard(mean_rows)


def test_jaccard_lower_similarity(mean_docs, mean_rows):
    assert _rows(op10.jaccard_components(mean_docs, percent=70, frequent=3), *OP10) == brute.jaccard(mean_rows, 70)


def test_jaccard_real(spark, sf_dir, real_rows):
    assert _rows(op10.query(spark, sf_dir), *OP10) == brute.jaccard(real_rows)


def test_one_of_each(mean_docs, mean_rows):
    got = op10.one_of_each(mean_docs)
    assert got.columns == mean_docs.columns
    by = {}
    for d, n, c in brute.jaccard(mean_rows):
        if n and c is not None:
            by.setdefault(c, d)
    kept = [r.doc_id for r in got.collect()]
    without = [d for d, n, c in brute.jaccard(mean_rows) if d is None or not n]
    assert sorted(kept, key=str) == sorted([*by, *without], key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(200, 200), (-5, -3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x or any(root(y) == x for y in up if y != x)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_in_one_task_or_in_rounds(spark):
    rng = random.Random(4)
    for n, m in ((1, 1), (40, 30), (300, 280), (300, 900)):
        name = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)]
        edges = [(rng.choice(name), rng.choice(name)) for _ in range(m)] + list(zip(name[: n // 4], name[1 : n // 4 + 1]))
        frame = spark.createDataFrame(edges, "u long, v long").repartition(3)
        one, rounds = ({r.node: r.root for r in components(frame, together).collect()} for together in (1 << 20, 0))
        assert one == rounds and set(one) == {x for u, v in edges if u != v for x in (u, v)}
        assert all(one[u] == one[v] <= min(u, v) and one[one[u]] == one[u] for u, v in edges if u != v)


def test_components_of_few_edges_take_few_jobs(spark):
    name = random.Random(6).sample(range(1 << 40), 500)
    context = spark.sparkContext
    context.setJobGroup("components", "")
    try:
        assert components(spark.createDataFrame(list(zip(name, name[1:])), "u long, v long")).agg({"root": "max"}).first()[0] == min(name)
        assert len(context.statusTracker().getJobIdsForGroup("components")) < 12
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_repeated_rows_are_spread_over_batches(spark, tmp_path):
    from tephra.llm.exchange import batches

    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text)] * 400 + [(None, text)] * 400 + [(i, f"{text} {i}") for i in range(2, 900)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(24).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        dealt, n = batches(docs, most=20_000)
        most = dealt.where(f"text = '{text}'").groupBy("batch", "doc_id").count().agg({"count": "max"}).first()[0]
        assert n > 50 and most < 200
        by_id, _ = batches(docs, by_id=True, most=20_000)
        assert by_id.where("doc_id is null").groupBy("batch").count().agg({"count": "max"}).first()[0] < 200
        assert _rows(op1.suffix_dedup(docs), *OP1) == brute.suffix_dedup(rows)
        assert _rows(op4.seed_extend_dedup(docs), *OP4) == brute.seed_extend(rows)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_tables(empty_docs):
    for df in (op1.suffix_dedup(empty_docs), op4.seed_extend_dedup(empty_docs), op10.jaccard_components(empty_docs), op10.one_of_each(empty_docs)):
        assert df.count() == 0
