from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tephra.llm import op6_lookup_sharding as op6
from tephra.llm import op8_poisson_mix as op8
from tephra.llm import op9_spaced_seeds as op9
from tephra.llm.queries import ORACLES, QUERIES
from tests.llm import brute


def _python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [n for n in ("Python", "Pandas", "Arrow", "ExternalRDD") if n in plan]


# ---------------------------------------------------------------- decontamination


def test_masks_are_complete():
    assert op9.complete(op9.MASKS, op9.WINDOW, op9.SUBSTITUTIONS, op9.STRIDE)
    assert not op9.complete(op9.MASKS[:1], op9.WINDOW, op9.SUBSTITUTIONS, op9.STRIDE)
    assert not op9.complete(("11111",), 12, 2) and op9.complete(("1111",), 12, 2)


def test_incomplete_masks_are_refused(mean_docs):
    with pytest.raises(ValueError):
        op9.overlaps(mean_docs, mean_docs, masks=("11111",))


def _planted(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    items = [(i, [word() for _ in range(rng.randint(12, 40))]) for i in range(12)] + [(90, [word() for _ in range(11)])]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            t = list(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(t) - 12))
            part = t[a : a + rng.randint(10, 30)]
            for _ in range(i % 5):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(body))
            body[at:at] = part
        text = " ".join(body)
        docs.append((i, text.upper().replace(" ", ", ", 3) if i % 3 else text))
    docs += [(None, " ".join(items[0][1])), (100, None), (101, ""), (102, " ".join(items[1][1])), (102, " ".join(items[1][1])), (102, "clean " * 30)]
    table = [(i, "The " + " ".join(t) if i == 3 else " ".join(t)) for i, t in items] + [(91, None), (92, "")]
    return docs, table


@pytest.mark.parametrize("how", [{}, {"block_bytes": 40_000, "most_blocks": 100}, {"block_bytes": 40_000, "most_blocks": 1}])
def test_overlaps_against_brute_force(spark, how):
    docs, items = _planted(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contaminated(docs, items)
    assert 15 < len(want) < 60
    found = op9.overlaps(frame, bench, **how)
    assert not _python_nodes(found)
    got = {(r.doc_id, tuple(r["items"])) for r in found.collect()}
    assert got == {(docs[r][0], tuple(sorted(i))) for r, i in want.items()}
    clean = op9.decontaminate(frame, bench, **how)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for r, (d, _) in enumerate(docs) if r not in want), key=str)


def test_long_items(spark):
    """Seeds of a long item don't carry the item."""
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(5000))) for i in range(20)]
    docs = [(i, " ".join(items[i][1].split()[1000 * (i % 5) : 1000 * (i % 5) + 20])) for i in range(10)] + [(50, "clean " * 30)]
    found = op9.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, tuple(r["items"])) for r in found.collect()} == {(i, (i,)) for i in range(10)}


def test_empty_benchmark_or_documents(spark, mean_docs, empty_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op9.decontaminate(mean_docs, none).count() == mean_docs.count()
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert op9.decontaminate(empty_docs, some).count() == 0


# ---------------------------------------------------------------- mixing


def test_mix_against_brute_force(mean_docs):
    got = op8.poisson_mix(mean_docs)
    assert not _python_nodes(got) and got.columns == [*mean_docs.columns, "copy_no", "shuffle_key"]
    rows = [(r.doc_id, r.source, r.n_chars) for r in mean_docs.select("doc_id", "source", "n_chars").collect()]
    want = Counter({n: k for (_, _, n), k in zip(rows, brute.poisson_counts([r[:2] for r in rows], op8.SEED)) if k})
    assert Counter(r.n_chars for r in got.collect()) == want
    keys = [r.shuffle_key for r in got.collect()]
    assert keys == sorted(keys)
    salted = op8.poisson_mix(mean_docs, broadcast_sources=1, salts=3)
    assert Counter(r.n_chars for r in salted.collect()) == want


def test_mix_reaches_its_weights(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, "big").when(F.col("id") < 8900, "mid").otherwise("small").alias("source"), F.lit(1).alias("copy_no"))
    weights = spark.createDataFrame([("big", 1.0), ("mid", 2.0), ("small", 1.0), ("gone", 5.0)], "source string, weight double")
    got = {r.source: r["count"] for r in op8.poisson_mix(docs, weights, total=8000).groupBy("source").count().collect()}
    assert set(got) == {"big", "mid", "small"} and abs(got["big"] - 2000) < 200 and abs(got["mid"] - 4000) < 260 and abs(got["small"] - 2000) < 200
    only = op8.poisson_mix(docs, spark.createDataFrame([("mid", 1.0), ("big", 0.0)], "source string, weight double"))
    assert [r.source for r in only.select("source").distinct().collect()] == ["mid"]
    other = op8.poisson_mix(docs, weights, seed="another").select("doc_id", "copy_no").exceptAll(op8.poisson_mix(docs, weights).select("doc_id", "copy_no"))
    assert other.count() > 100


def test_mix_refuses_rates_over_a_given_one_and_keeps_empty(spark, empty_docs):
    assert op8.poisson_mix(empty_docs).count() == 0
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    with pytest.raises(Exception, match="rate"):
        op8.poisson_mix(docs, total=10_000, most_rate=500).collect()


def test_mix_of_a_rare_source_beside_a_large_one(spark):
    """One document of a null source beside 300,000 of another has a rate of some 548."""
    docs = spark.range(300_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "a").alias("source"))
    got = {r.source: r["count"] for r in op8.poisson_mix(docs).groupBy("source").count().collect()}
    assert abs(got[None] - 547) < 120 and abs(got["a"] - 299_454) < 2800


def test_mix_carries_columns_of_any_name(spark):
    rows = [(i, f"s{i % 3}", i, i, i, i, i, i, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, `count` long, u long, cdf long, least long, id long, `__salt` long, `a.b` long")
    for more in ({}, {"broadcast_sources": 1, "salts": 3}):
        out = op8.poisson_mix(docs, **more)
        assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
        got = out.collect()
        assert got and all(set(r[2:9]) == {r.doc_id} for r in got)


# ---------------------------------------------------------------- sharding


def test_table_is_even_and_moves_little():
    t = op6.lookup_table(op6.names(10), 10_007)
    sizes = Counter(t)
    assert set(sizes) == set(range(10)) and max(sizes.values()) - min(sizes.values()) <= 1
    less = op6.lookup_table([n for n in op6.names(10) if n != "shard-00004"], 10_007)
    back = [i if i < 4 else i + 1 for i in less]
    moved = sum(a != b for a, b in zip(t, back) if a != 4)
    assert moved < 0.15 * 10_007
    for bad in ((op6.names(3), 10), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            op6.lookup_table(*bad)


def test_shards(mean_docs, empty_docs):
    got = op6.shard(mean_docs)
    assert not _python_nodes(got) and got.count() == mean_docs.count()
    t = op6.lookup_table(op6.names(op6.SHARDS), op6.SLOTS)
    for r in got.collect():
        assert r.slot == brute.number(r.doc_id) % op6.SLOTS and r.shard == t[r.slot]
    assert [c for c in got.columns if c in ("slot", "shard")] == ["slot", "shard"]
    assert op6.shard(empty_docs, shards=["a", "b"], slots=11).count() == 0


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", ["op5_licence_digest", "op6_lookup_sharding", "op9_spaced_seeds"])
def test_query_against_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = lambda f: sorted(tuple(str(v) for v in r) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False))
    assert rows(got.toPandas()) == rows(c.execute(ORACLES[name]).df())


def test_pipeline_against_brute_force(spark, sf_dir):
    """Stage by stage on its own input, and the whole run."""
    from tephra.llm import op2_line_frequency as op2

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    duckdb = pytest.importorskip("duckdb")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame = docs.toPandas()
    c = duckdb.connect()
    c.register("documents", frame)
    kept = set(c.execute(op2.ORACLE).df().query("kept").doc_id)
    cleaned = brute.without_common_lines(list(zip(frame.text, frame.source)))
    rows = [(int(d), t) for d, t in zip(frame.doc_id, cleaned) if d in kept]
    # near copies by the contract's five words and similarity 0.8; documents of this table have an id each
    rows = [r for r in rows if any(r[0] == x and (n == 0 or x == k) for x, n, k in brute.jaccard(rows, 80, 5))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = brute.contaminated(rows, items)
    rows = [r for i, r in enumerate(rows) if i not in leaks]
    source = dict(zip(frame.doc_id, frame.source))
    counts = brute.poisson_counts([(d, source[d]) for d, _ in rows], op8.SEED)
    want = Counter({d: n for (d, _), n in zip(rows, counts) if n})
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "slot", "shard"]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == want
    left = dict(rows)
    assert all(r.text == left[r.doc_id] for r in got)
    assert all(r.slot == brute.number(r.doc_id) % op6.SLOTS for r in got)


def test_pipeline_stages_on_a_mean_table(spark, sf_dir, mean_docs, empty_docs):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, stage by stage."""
    docs = mean_docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.columns == (docs.columns if k < 4 else [*[c for c in docs.columns if c != "shard"], "slot", "shard"])
        assert 0 < out.count()
        none = stage(spark, empty_docs, sf_dir)
        assert none.count() == 0 and none.columns[:5] == empty_docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_pipeline_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
