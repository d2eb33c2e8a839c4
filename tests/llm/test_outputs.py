"""What the operators return beside the columns of their queries."""

from __future__ import annotations

import hashlib
import textwrap

import pytest

from tephra.llm import op1_suffix_dedup as op1
from tephra.llm import op4_seed_extend as op4
from tephra.llm import op5_licence_digest as op5
from tests.llm import brute


duckdb = pytest.importorskip("duckdb")


def _without(items, spans):
    cut = {i for s in spans for i in range(s.start, s.end)}
    return [x for i, x in enumerate(items) if i not in cut]


def test_dedup_returns_kept_texts_and_spans(spark, mean_rows):
    rows = [r for r in mean_rows if r[1] is None or len(r[1]) < 3000]
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(2)
    of = {}
    for d, t in rows:
        of.setdefault(d, []).append((t or "").encode())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    out = op1.suffix_dedup(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, digest(r.kept)) for r in out), key=str) == brute.suffix_dedup(rows)
    for r in out:
        assert any(bytes(_without(b, r.spans)) == r.kept for b in of[r.doc_id]) and len(r.spans) == r.n_spans
    out = op4.seed_extend_dedup(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, digest(r.kept.encode())) for r in out), key=str) == brute.seed_extend(rows)
    for r in out:
        assert any(b" ".join(_without(brute.words(b.decode()), r.spans)) == r.kept.encode() for b in of[r.doc_id]) and len(r.spans) == r.n_repeats


def test_whole_licences_wrapped_anew(spark):
    known = dict(op5.known_licences())
    assert {"Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(known)
    bsd = known["BSD-2-Clause"]
    assert "above copyright notice" in bsd
    apache = "\n\n".join(textwrap.fill(" ".join(p.split()), 50) for p in known["Apache-2.0"].split("\n\n"))
    assert any(x.startswith("copyright") for x in apache.split("\n"))
    rows = list(enumerate([*known.values(), bsd.replace("above copyright notice", "above\n copyright notice"), apache, bsd.replace("Copyright (c) <year> <owner>", "Copyright Some One"), known["MIT"] + " more"]))
    for name, text in known.items():  # wrapped anew, and on one line
        for width in (50, 72, 80, 0):
            paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
            rows.append((len(rows), "\n\n".join(textwrap.fill(p, width) for p in paragraphs) if width else " ".join(text.split())))
    names = [*known, "BSD-2-Clause", "Apache-2.0", "BSD-2-Clause", None, *[name for name in known for _ in range(4)]]
    out = {r.doc_id: r.licence for r in op5.licence_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict(enumerate(names))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sql = duckdb.connect()
    sql.register("documents", docs.toPandas())
    assert sorted((d, x if x == x else None) for d, x in sql.execute(f"SELECT doc_id, licence FROM ({op5.ORACLE})").fetchall()) == sorted(out.items())
    mit = known["MIT"]
    notices = ["Copyright 2020 A B", "(c) 2001-2003 C D. All rights reserved.", "© E F", "Copyright (c) 1999 G, 51 Some Street\nCopyright H"]
    copies = [mit.replace("Copyright (c) <year> <copyright holders>", n) for n in notices] + [mit.replace("Copyright (c) <year> <copyright holders>", "word " * 3)]
    out = {r.doc_id: r.licence for r in op5.licence_digests(spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")).collect()}
    assert out == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None}
    own = spark.createDataFrame([("x", "a wilful act")], "licence string, text string")
    assert op5.licence_digests(spark.createDataFrame([(1, "A willful act")], "doc_id long, text string"), own).first().licence == "x"
