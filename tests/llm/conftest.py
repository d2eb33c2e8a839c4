from __future__ import annotations

import random

import pytest

pytest.importorskip("tephra.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def mean_rows():
    """Texts with nulls, empty and very long ones, copies, near copies, repeated rows, ties and a hot passage."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(150), text(60)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (None, base), (None, None), (6, base), (7, base), (7, base), (8, base.upper())]
    for i in range(30):
        w = base.split()
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "edit"
        rows.append((10 + i, " ".join(w)))
    rows += [(50 + i, f"{text(20)}\n{passage}\n{text(25)}") for i in range(40)]
    rows += [(100, "a" * 900), (101, "ab " * 400), (102, text(6000)), (102, text(30)), (103, "é" * 300), (104, passage), (105, "x " * 12)]
    rows += [(200 + i, text(rng.randint(1, 60))) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def mean_docs(spark, mean_rows):
    """The rows with columns whose names the operators use themselves."""
    rows = [(d, t, "en", f"s{i % 3}" if i % 7 else None, i, i, i, str(i), i, i) for i, (d, t) in enumerate(mean_rows)]
    return spark.createDataFrame(rows, SCHEMA + ", batch int, node long, host string, row long, shard int").repartition(3)


@pytest.fixture(scope="session")
def real_rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
