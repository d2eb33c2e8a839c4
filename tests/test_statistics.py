from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.functions import statistics as st
from tephra.operators import correlate as co
from tephra.operators import kernels as k
from tephra.operators import sweep as sw
from tests.helpers import values, weekly

BY = ["series_id"]


def _ar(rng, n, phi):
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + rng.normal()
    return x


def test_p_of_r_against_tables():
    # two-sided 5 % points of t: 2.228 at 10, 2.042 at 30, 12.706 at 1 degree of freedom
    for df, t in ((10, 2.2281), (30, 2.0423), (1, 12.7062), (1000, 1.9623)):
        r = t / np.sqrt(df + t * t)
        assert abs(float(k.p_of_r(r, df + 2)) - 0.05) < 1e-4
    assert np.isnan(k.p_of_r(0.5, 2)) and np.isnan(k.p_of_r(1.0, 10)) and abs(float(k.p_of_r(0.0, 10)) - 1) < 1e-12


def test_correlate_and_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = 0.6 * x + rng.normal(size=60)
    x[5] = np.nan
    row = co.correlate(weekly(spark, {"x": x, "y": y}), "x", "y", BY).first()
    ok = ~np.isnan(x)
    r = np.corrcoef(x[ok], y[ok])[0, 1]
    assert abs(row.r - r) < 1e-9 and row.n == 59
    assert abs(row.ci_low - np.tanh(np.arctanh(r) - 1.959963984540054 / np.sqrt(56))) < 1e-9
    flat = co.correlate(weekly(spark, {"x": np.ones(10), "y": np.arange(10.0)}), "x", "y", BY).first()
    assert (flat.r, flat.p, flat.ci_low) == (0.0, 1.0, None)


def test_lead_is_found_at_the_planted_lag(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=120)
    y = np.r_[rng.normal(size=3), 2 * x[:-3]] + 0.1 * rng.normal(size=120)
    table = co.ccf(weekly(spark, {"x": x, "y": y}), "x", "y", 8, BY)
    peak = co.peak(table, BY).first()
    assert peak.peak_lag == 3 and peak.peak_r > 0.95 and peak.n_overlap == 120
    for row in table.collect():
        a, b = sw._moved(x, y, row.lag)
        assert abs(row.r - np.corrcoef(a, b)[0, 1]) < 1e-9 and row.n == 120 - abs(row.lag)
    assert sw.best_lag(x, y, 8)[0] == 3


def test_planted_null_is_null(spark):
    rng = np.random.default_rng(99)
    row = co.correlate(weekly(spark, {"x": rng.normal(size=120), "y": rng.normal(size=120)}), "x", "y", BY).first()
    assert abs(row.r) < 0.3 and row.p > 0.05


def test_dependence_in_spark_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = _ar(rng, 150, 0.8), _ar(rng, 150, 0.7)
    df = weekly(spark, {"x": x, "y": y})
    got = {r.lag: r.rho for r in co.autocorrelations(df, "x", 4, BY).collect()}
    assert np.allclose([got[j] for j in range(1, 5)], k.autocorrelations(x, 4))
    row = co.effective_n(df, "x", "y", BY).first()
    assert np.allclose([row.n_eff_first, row.n_eff_nw], [k.pairs_worth(x, y), k.pairs_worth(x, y, k.bartlett_width(150))]) and row.n == 150
    assert abs(co.lag1_by_corr(df, "x", BY).first().lag1 - np.corrcoef(x[1:], x[:-1])[0, 1]) < 1e-9


def test_fdr_vector(spark):
    df = spark.createDataFrame([("a", p) for p in (0.001, 0.01, 0.02, 0.5, 0.8, None)], "f string, p double")
    out = co.bh_fdr(df, "p", ["f"]).orderBy("p").collect()
    assert out[0].p_fdr is None and not out[0].fdr_reject
    assert np.allclose([r.p_fdr for r in out[1:]], [0.005, 0.025, 0.1 / 3, 0.625, 0.8])
    assert [r.fdr_reject for r in out[1:]] == [True, True, True, False, False]


def test_block_length(spark):
    df = spark.range(1, 400).withColumn("b", st.block_length(F.col("id")))
    assert all(r.b == k.blocks_of(r.id) for r in df.collect())


def test_resampling_is_fixed_by_its_seed_and_allows_for_dependence():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=80), rng.normal(size=80)
    assert k.bootstrap_interval(x, y, 4, 200, 1) == k.bootstrap_interval(x, y, 4, 200, 1) != k.bootstrap_interval(x, y, 4, 200, 2)
    assert k.permutation_p(x, x, 4, 99, 1) == 0.01
    assert np.isnan(k.permutation_p(x[:6], y[:6], 4, 99, 1)) and np.isnan(k.bootstrap_interval(np.ones(80), y, 4, 9, 1)[0])
    naive = robust = 0
    for _ in range(40):
        a, b = _ar(rng, 160, 0.8), _ar(rng, 160, 0.8)
        naive += float(k.p_of_r(k.correlation(a, b), 160)) < 0.05
        robust += k.permutation_p(a, b, 16, 199, 1) < 0.05
    assert naive > 8 and robust < naive


def test_bootstrap_matches_a_plain_loop():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=37), rng.normal(size=37)
    own, rs = np.random.default_rng(11), []
    for _ in range(50):
        begins = own.choice(np.arange(0, 37 - 3 + 1), size=13, replace=True)
        pick = np.concatenate([np.arange(s, s + 3) for s in begins])[:37]
        rs.append(np.corrcoef(x[pick], y[pick])[0, 1])
    assert np.allclose(k.bootstrap_interval(x, y, 3, 50, 11), np.quantile(rs, [0.025, 0.975]))


def test_matrix_pairs_once(spark):
    rng = np.random.default_rng(2)
    cols = {c: rng.normal(size=20) for c in "abc"}
    cols["c"][:10] = np.nan
    long = weekly(spark, cols).unpivot(["date"], ["a", "b", "c"], "name", "value")
    out = co.matrix(long).collect()
    assert [(r.a, r.b) for r in out] == [("a", "b")] and abs(out[0].r - np.corrcoef(cols["a"], cols["b"])[0, 1]) < 1e-9


def test_robust_rows_and_verdicts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=100)
    frames = [weekly(spark, {"x": x, "y": x + 0.1 * rng.normal(size=100)}, key="strong"), weekly(spark, {"x": x, "y": rng.normal(size=100)}, key="none"), weekly(spark, {"x": x[:10], "y": x[:10]}, key="short")]
    df = frames[0].union(frames[1]).union(frames[2])
    rows = sw.verdicts(sw.robust_correlations(df, "x", "y", BY, draws_boot=200, draws_perm=200), tie=BY).collect()
    zero = {r.series_id: r for r in rows if r.lag_kind == "lag0"}
    assert set(zero) == {"strong", "none"} and zero["strong"].verdict == "robust" and zero["none"].verdict == "ns"
    again = sw.robust_correlations(df, "x", "y", BY, draws_boot=200, draws_perm=200).where("series_id = 'none' and lag = 0").first()
    assert (again.boot_lo, again.p_perm) == (zero["none"].boot_lo, zero["none"].p_perm)


def test_labels(spark):
    df = spark.createDataFrame([(0.8, 2, True), (0.6, -1, True), (0.6, 3, True), (0.9, 3, False), (-0.3, 1, True)], "r double, lag int, s boolean")
    out = df.select(st.bar_class(F.col("r"), (0.5, 0.75)).alias("bar"), st.lead_conclusion(F.col("s"), F.col("r"), F.col("lag"), (0.5, 0.75)).alias("c"), st.sign_label(F.col("r"), F.col("s")).alias("g")).collect()
    assert [r.bar for r in out] == ["above-bar", "in-band", "in-band", "above-bar", "below-bar"]
    assert [r.c for r in out] == ["lead", "concurrent", "lead", "null", "null"]
    assert [r.g for r in out] == ["positive", "positive", "positive", "indeterminate", "negative"]


def test_levels_can_part_from_residuals(spark):
    t = np.arange(120.0)
    wave = np.sin(t)
    df = weekly(spark, {"e": wave, "x": wave - t, "y": 99 * wave + t})
    row = co.levels_relationship(df, "e", "x", "y").first()
    assert row.levels_r < 0 < row.residual_r and row.decoupled
    assert values(df, "e")[0] == 0
    with pytest.raises(Exception):
        co.correlate(df, "nope", "y")


def test_adjusted_p_of_a_large_family(spark):
    """The running least must not look at the whole family again for each row."""
    import time

    n = 200_000
    df = spark.range(n).select(F.lit("a").alias("f"), ((F.col("id") * 7919) % n / float(n)).alias("p"))
    began = time.perf_counter()
    out = co.bh_fdr(df, "p", ["f"]).agg(F.min("p_fdr"), F.max("p_fdr"), F.count("p_fdr")).first()
    # p * m / rank of evenly spaced p is (i - 1) / i of 1, and the least from a rank on is that of the rank itself
    assert out[0] == 0.0 and abs(out[1] - (n - 1) / n) < 1e-9 and out[2] == n and time.perf_counter() - began < 60
