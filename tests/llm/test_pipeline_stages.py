"""Stages of the pipeline against brute force."""

from __future__ import annotations

import math
import os
import random

import corpus_pipeline
from tephra.llm import op8_poisson_mix as op8
from tests.llm import brute


def _components(sets, percent):
    """Root of each set of shingles, by comparing all of them."""
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both * 100 >= percent * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def _near_copies():
    """(doc_id, text): of each text some with one to four words exchanged; similarities on both sides of the limits."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows = []
    for i in range(25):
        base = [word() for _ in range(rng.randint(20, 90))]
        for k in range(5):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = word()
            rows.append((10 * i + k, " ".join(w)))
    return rows


def test_near_duplicates_stage_takes_five_words_at_four_fifths(spark):
    rows = _near_copies()

    def firsts(n_words, percent):
        of = _components([brute.shingles(t, n_words) for _, t in rows], percent)
        least = {}
        for r, (d, _) in zip(of, rows):
            least[r] = min(least.get(r, d), d)
        return sorted(least.values())

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == firsts(5, 80) and len(got) < len(firsts(3, 90))


def test_one_of_each_keeps_components_with_one_smallest_id(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text("a")), (1, text("b")), (2, text("a")), (3, text("b")), (4, text("c"))], "doc_id long, text string")
    got = sorted((r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(1, "a"), (1, "b"), (4, "c")]


def test_quality_stage_removes_lines_above_the_limits(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    menu = "HOME  About 12 é contact " + " ".join(f"m{j}" for j in range(20))
    rows = [(i, f"{own(i)}\n{menu}", "a", 7) for i in range(12)]
    rows += [(20, f"{menu.replace('12', '97')}\n\n{own(20)}\n {menu.lower()}\n{own(21)}\n", "a", None), (22, menu, "b", 5), (23, f"{menu}\nleft", "a", 3), (None, own(99), None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(2)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    mixed = f"\n{own(20)}\n{own(21)}\n"
    want = {i: (own(i), len(own(i))) for i in range(12)} | {20: (mixed, len(mixed)), 22: (menu, 5), None: (own(99), 9)}
    assert got == want


def test_mix_serves_a_single_row_with_a_rate_of_thousands(spark):
    docs = spark.createDataFrame([(i, "rare") for i in range(40)] + [(100, "big")], "doc_id long, source string")
    weights = spark.createDataFrame([("rare", 1.0), ("big", 1e-9)], "source string, weight double")
    got = {r.doc_id: r["count"] for r in op8.poisson_mix(docs, weights, total=40 * 6000, most_rate=None).groupBy("doc_id").count().collect()}
    # the quantile of a Poisson distribution by logarithms
    def count(u, rate):
        total, k = 0.0, 0
        while (total := total + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) <= u:
            k += 1
        return k

    rate = 6000 / (1 + 1e-9)
    assert got == {i: count(brute.number(op8.SEED, i) / 2**48, rate) for i in range(40)}
    one = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert abs(op8.poisson_mix(one, total=10_000, most_rate=None).count() - 10_000) < 600


def test_tables_between_stages_are_removed(spark):
    from tephra.llm.shared import remove, written

    one, other = written(spark.range(5).toDF("x"), "stage-0"), written(spark.range(3).toDF("x"), "stage-1")
    there = lambda df: [os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles()]
    assert all(there(one))
    remove(one)
    assert not any(there(one)) and all(there(other)) and other.count() == 3
