"""Sweeps: many variants of a signal against one target, as one long frame and one grouped function."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.operators import kernels
from tephra.operators.correlate import bh_fdr

ROBUST = "r double, n int, p_naive double, n_eff_first double, p_eff_first double, n_eff_nw double, p_eff_nw double, boot_lo double, boot_hi double, p_perm double, block int"


def robust_row(x: np.ndarray, y: np.ndarray, draws_boot: int, draws_perm: int, seed: int) -> dict:
    """Correlation with significance that allows for dependence."""
    n = len(x)
    if n < 3 or x.std() == 0 or y.std() == 0:
        floor = float(max(n, 2))
        return {"r": 0.0, "n": n, "p_naive": 1.0, "n_eff_first": floor, "p_eff_first": 1.0, "n_eff_nw": floor, "p_eff_nw": 1.0, "boot_lo": np.nan, "boot_hi": np.nan, "p_perm": 1.0, "block": 0}
    r, block = float(kernels.correlation(x, y)), kernels.blocks_of(n)
    first, nw = kernels.pairs_worth(x, y), kernels.pairs_worth(x, y, kernels.bartlett_width(n))
    low, high = kernels.bootstrap_interval(x, y, block, draws_boot, seed)
    p = [float(kernels.p_of_r(r, m)) for m in (n, first, nw)]
    return {"r": r, "n": n, "p_naive": p[0], "n_eff_first": first, "p_eff_first": p[1], "n_eff_nw": nw, "p_eff_nw": p[2], "boot_lo": low, "boot_hi": high, "p_perm": kernels.permutation_p(x, y, block, draws_perm, seed), "block": block}


def _moved(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """x moved k rows on, against y."""
    return (x[: len(x) - k], y[k:]) if k >= 0 else (x[-k:], y[: len(y) + k])


def best_lag(x: np.ndarray, y: np.ndarray, most: int, least: int = 3) -> tuple[int, float]:
    best = (0, 0.0)
    for i, k in enumerate(range(-most, most + 1)):
        a, b = _moved(x, y, k)
        r = float(kernels.correlation(a, b)) if len(a) >= least and a.std() > 0 and b.std() > 0 else 0.0
        if i == 0 or abs(r) > abs(best[1]):
            best = (k, r)
    return best


def robust_correlations(df: DataFrame, x: str, y: str, by: Sequence[str], *, max_lag: int = 8, min_overlap: int = 26, draws_boot: int = 5000, draws_perm: int = 5000, seed: int = 20260614, date: str = "date") -> DataFrame:
    """For each key the correlation at lag 0 and, where it lies elsewhere, at the peak lag, with robust significance."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        ok = ~np.isnan(a) & ~np.isnan(b)
        a, b = a[ok], b[ok]
        rows = []
        if len(a) >= min_overlap:
            rows.append({"lag": 0, "lag_kind": "lag0", **robust_row(a, b, draws_boot, draws_perm, seed)})
            k, _ = best_lag(a, b, max_lag)
            p, q = _moved(a, b, k)
            if k and len(p) >= min_overlap:
                rows.append({"lag": k, "lag_kind": "peak", **robust_row(p, q, draws_boot, draws_perm, seed)})
        out = pd.DataFrame(rows, columns=["lag", "lag_kind", *[c.split()[0] for c in ROBUST.split(", ")]])
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "lag int, lag_kind string", ROBUST])
    out = df.select(*by, date, x, y).groupBy(*by).applyInPandas(f, schema)
    return out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def verdicts(rows: DataFrame, alpha: float = 0.05, tie: Sequence[str] = ()) -> DataFrame:
    """Adjusts p within each kind of lag, never across, and names the outcome of each row."""
    out = bh_fdr(rows, "p_perm", ["lag_kind"], alpha, tie)
    apart = F.coalesce((F.col("boot_lo") > 0) | (F.col("boot_hi") < 0), F.lit(False))
    return out.withColumn("verdict", F.when(F.col("fdr_reject") & apart, "robust").when(F.col("p_naive") < 0.05, "fragile (naive-only)").otherwise("ns"))


def dependence_verdict(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Four outcomes of naive against robust significance."""
    naive = F.col("p_naive") < alpha
    robust = (F.col("p_perm") < alpha) & F.coalesce((F.col("boot_lo") > 0) | (F.col("boot_hi") < 0), F.lit(False))
    return rows.withColumn("verdict", F.when(naive & robust, "robust").when(naive, "fragile (naive-only)").when(robust, "robust (naive missed)").otherwise("ns"))
