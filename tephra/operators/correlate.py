"""Correlation, lead-lag, dependence and multiplicity, over many pairs of series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tephra.functions import statistics as st
from tephra.operators.series import ordered


def _paired(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def _degenerate(x: str, y: str, n):
    return (n < 3) | (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))


def correlate(df: DataFrame, x: str, y: str, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """r, n, interval and p of each pair; r 0 and p 1 where there are under 3 pairs or no variance."""
    n = F.count("*")
    flat = _degenerate(x, y, n)
    out = _paired(df, x, y).groupBy(*by).agg(F.when(flat, 0.0).otherwise(st.pearson(x, y)).alias("r"), n.alias("n"), flat.alias("__flat"))
    out = out.withColumn("ci_low", F.when(~F.col("__flat"), st.fisher_low(F.col("r"), F.col("n")))).withColumn("ci_high", F.when(~F.col("__flat"), st.fisher_high(F.col("r"), F.col("n"))))
    if with_p:
        out = out.withColumn("p", F.when(F.col("__flat"), 1.0).otherwise(st.p_of_r(F.col("r"), F.col("n").cast("double"))))
    return out.drop("__flat")


def ccf(df: DataFrame, x: str, y: str, max_lag: int = 8, by: Sequence[str] = (), date: str = "date", least: int = 3) -> DataFrame:
    """Correlation of x moved by each lag with y; a positive lag means that x leads. Lags are rows.

    Every row carries its moved values as one array, made by a single window, and one aggregation correlates all lags.
    """
    w = ordered(by, date)
    lags = [F.struct(F.lit(k).alias("lag"), (F.lag(x, k).over(w) if k >= 0 else F.lead(x, -k).over(w)).alias("x"), F.col(y).alias("y")) for k in range(-max_lag, max_lag + 1)]
    long = df.select(*by, F.array(*lags).alias("p")).select(*by, F.explode("p").alias("p")).select(*by, "p.lag", "p.x", "p.y")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    a, b, n = F.when(both, F.col("x")), F.when(both, F.col("y")), F.count(F.when(both, 1))
    flat = (n < least) | (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return long.groupBy(*by, "lag").agg(F.when(flat, 0.0).otherwise(st.pearson(a, b)).alias("r"), n.alias("n"))


def peak(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The lag of the largest absolute correlation (the most negative lag of equals) and the noise band at lag 0."""
    best = F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag"))).alias("best")
    out = table.groupBy(*by).agg(best, F.max(F.when(F.col("lag") == 0, F.col("n"))).alias("n_overlap"))
    return out.select(*by, F.col("best.lag").alias("peak_lag"), F.col("best.r").alias("peak_r"), "n_overlap", F.when(F.col("n_overlap") > 0, 1.96 / F.sqrt("n_overlap")).alias("band"))


def autocorrelations(df: DataFrame, value: str, max_lag: int, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Autocorrelation at lags 1..max_lag about the whole mean, over all rows of a series without NULLs."""
    own = Window.partitionBy(*by)
    centred = df.where(F.col(value).isNotNull()).withColumn("__c", F.col(value) - F.avg(value).over(own))
    w = ordered(by, date)
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("__c", k).over(w).alias("before")) for k in range(1, max_lag + 1)])
    long = centred.select(*by, "__c", lags.alias("p")).select(*by, "__c", F.explode("p").alias("p")).select(*by, "__c", "p.lag", "p.before")
    return long.groupBy(*by, "lag").agg(F.coalesce(F.sum(F.col("__c") * F.col("before")) / F.nullif(F.sum(F.col("__c") * F.col("__c")), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def lag1_by_corr(df: DataFrame, value: str, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Lag-1 autocorrelation as the correlation of neighbours, each about its own mean."""
    return df.where(F.col(value).isNotNull()).withColumn("__b", F.lag(value).over(ordered(by, date))).groupBy(*by).agg(st.pearson(value, "__b").alias("lag1"))


#: Lags for which the Bartlett window can have weight, up to a million points.
MOST_LAGS = 31


def effective_n(df: DataFrame, x: str, y: str, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """n, and effective n from lag 1 and over a Bartlett window, each between 2 and n."""
    pairs = _paired(df, x, y)
    long = pairs.select(*by, date, F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col(x).alias("v")), F.struct(F.lit("y").alias("side"), F.col(y).alias("v")))).alias("p")).select(*by, date, "p.side", "p.v")
    rho = autocorrelations(long, "v", MOST_LAGS, (*by, "side"), date)
    product = rho.groupBy(*by, "lag").agg(F.max(F.when(F.col("side") == "x", F.col("rho"))).alias("a"), F.max(F.when(F.col("side") == "y", F.col("rho"))).alias("b")).withColumn("ab", F.col("a") * F.col("b"))
    sizes = pairs.groupBy(*by).agg(F.count("*").alias("n"), _degenerate(x, y, F.count("*")).alias("flat"))
    joined = product.join(sizes, list(by)) if by else product.crossJoin(F.broadcast(sizes))  # one row where there are no keys
    width = F.greatest(F.lit(1), F.least(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))), F.col("n") - 2))
    term = F.when(F.col("lag") <= width, (1 - F.col("lag") / (width + 1)) * F.col("ab")).otherwise(0.0)
    sums = joined.groupBy(*by, "n", "flat").agg(F.max(F.when(F.col("lag") == 1, F.col("ab"))).alias("ab1"), (1 + 2 * F.sum(term)).alias("spread"))
    n = F.col("n").cast("double")
    clamp = lambda v: F.least(F.greatest(v, F.lit(2.0)), n)
    first = F.when(F.col("flat"), F.greatest(n, F.lit(2.0))).when(1 + F.col("ab1") > 0, clamp(n * (1 - F.col("ab1")) / (1 + F.col("ab1")))).otherwise(2.0)
    second = F.when(F.col("flat"), F.greatest(n, F.lit(2.0))).when(F.col("spread") > 0, clamp(n / F.col("spread"))).otherwise(2.0)
    return sums.select(*by, "n", first.alias("n_eff_first"), second.alias("n_eff_nw"))


def bh_fdr(df: DataFrame, p: str, by: Sequence[str] = (), alpha: float = 0.05, tie: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p and rejection within each family; NULL p stays and doesn't count."""
    ranked = Window.partitionBy(*by, F.col(p).isNull()).orderBy(p, *tie)
    family = Window.partitionBy(*by, F.col(p).isNull())
    rank = F.row_number().over(ranked)
    # the least from a rank on is a running least from the last rank down: a frame that only grows
    down = Window.partitionBy(*by, F.col(p).isNull()).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__rank", rank).withColumn("__rough", F.col(p) * F.count(p).over(family) / F.col("__rank"))
    out = out.withColumn("p_fdr", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__rough").over(down))))
    return out.withColumn("fdr_reject", F.coalesce(F.col("p_fdr") <= alpha, F.lit(False))).drop("__rough", "__rank")


def matrix(long: DataFrame, name: str = "name", value: str = "value", on: Sequence[str] = ("date",), least: int = 12) -> DataFrame:
    """Pairwise-complete correlations (a < b) of series with more than `least` values.

    Series of one date are gathered into an array and paired there, so the dates aren't joined with themselves. The
    result has a row for every pair of series, so this is for the hundreds of series that a reader can compare.
    """
    known = long.where(F.col(value).isNotNull())
    counts = known.groupBy(name).agg(F.count("*").alias("__c")).where(F.col("__c") > least).select(name)
    rows = known.join(counts, name, "left_semi").groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("v")))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["n"] > a["n"]), lambda b: F.struct(a["n"].alias("a"), b["n"].alias("b"), a["v"].alias("x"), b["v"].alias("y")))))
    long_pairs = rows.select(F.explode(pairs).alias("p")).select("p.*")
    return long_pairs.groupBy("a", "b").agg(st.pearson("x", "y").alias("r"), F.count("*").alias("n"))


def strongest(table: DataFrame, least: float = 0.3, k: int = 15) -> DataFrame:
    """The k pairs of largest abs(r) from `least` on."""
    return table.where(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def fit_line(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def levels_relationship(df: DataFrame, residual: str, level: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of levels beside that of residuals, and whether they part (levels down, residuals up)."""
    n = F.count(F.when(F.col(level).isNotNull() & F.col(target).isNotNull(), 1))
    out = df.groupBy(*by).agg(F.when(n >= 3, st.pearson(level, target)).alias("levels_r"), st.pearson(residual, target).alias("residual_r"), n.alias("n"))
    return out.withColumn("decoupled", F.coalesce((F.col("levels_r") < 0) & (F.col("residual_r") > 0), F.lit(False)))
