"""Hashes of runs, against equality of the runs themselves."""

from __future__ import annotations

import numpy as np
import pytest

from tephra.llm import op2_line_frequency as op2
from tephra.llm import op4_seed_extend as op4
from tephra.llm import op10_jaccard_join as op10
from tephra.llm.text import Hashes
from tests.llm import brute


def _pair(n: int) -> tuple[str, str]:
    """Two texts of 2 ** n letters that every polynomial hash modulo 2 ** 64 takes for one from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("make", [Hashes, lambda v: Hashes.of_bytes(v.astype(np.uint8)), lambda v: Hashes.of_bytes(v.astype(np.uint8), 32)])
def test_equal_hashes_are_equal_runs(make):
    rng = np.random.default_rng(0)
    items = rng.integers(0, 3, 3000).astype(np.uint64)
    hashes, moved = make(items), make(np.concatenate([items[5:], items]))
    start = rng.integers(0, 3001, 20_000)
    end = np.minimum(3000, start + rng.integers(0, 400, len(start)))
    of = hashes.of(start, end)
    runs = {items[s:e].tobytes(): h for s, e, h in zip(start, end, of.tolist())}
    assert all(runs[items[s:e].tobytes()] == h for s, e, h in zip(start, end, of.tolist())) and len(set(runs.values())) == len(runs)
    assert (moved.of(start + 2995, end + 2995) == of).all()
    for width in (1, 3, 8, 13, 32, 200):
        every = hashes.every(width)
        assert len(every) == 3001 - width and len(set(every.tolist())) == len({items[i : i + width].tobytes() for i in range(len(every))})
    assert len(make(items[:4]).every(5)) == 0


def test_long_words_and_lines_are_told_apart(spark):
    a, b = _pair(11)
    rows = [(1, f"{a}\n{b}\n{a}"), (2, " ".join([a] + [f"w{i}" for i in range(20)])), (3, " ".join([b] + [f"w{i}" for i in range(20)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source")
    assert {r.doc_id: r.n_dup_lines for r in op2.line_frequency_rules(docs).collect()} == {1: 1, 2: 0, 3: 0}
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op4.seed_extend_dedup(docs).collect()), key=str)
    assert got == brute.seed_extend(rows)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op10.jaccard_components(docs).collect()), key=str)
    assert got == brute.jaccard(rows)
