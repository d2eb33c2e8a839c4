"""From a footprint signal to a relative activity index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tephra.errors import UnknownStrategyError
from tephra.functions.calendar import heating_season
from tephra.operators import trend
from tephra.operators.series import ordered

METHODS = ("yoy", "stl", "yoy-double-diff", "intensity-model", "prophet", "harmonic", "none")


def deseasonalise(df: DataFrame, value: str, by: Sequence[str], method: str = "yoy", period: int = 52, name: str = "deseasoned") -> DataFrame:
    """Removes the season of each series by rows of its period; NULL stays NULL."""
    if method not in METHODS:
        raise UnknownStrategyError("deseason method", method, METHODS)
    w = ordered(by)
    yoy = F.col(value) - F.lag(value, period).over(w)
    if method == "none":
        return df.withColumn(name, F.col(value))
    if method == "yoy":
        return df.withColumn(name, yoy)
    if method == "yoy-double-diff":
        return df.withColumn("__yoy", yoy).withColumn(name, F.col("__yoy") - F.lag("__yoy").over(w)).drop("__yoy")
    return trend.fitted_deseason(df, value, by, method, period, name)


def without_term(df: DataFrame, value: str, term: str, by: Sequence[str]) -> DataFrame:
    """Removes one 0/1 term: the mean of its side. Series in which it doesn't vary, or with under 3 rows, stay."""
    known = F.col(value).isNotNull() & F.col(term).isNotNull()
    side = Window.partitionBy(*by, term, known)
    every = Window.partitionBy(*by)
    usable = (F.size(F.collect_set(F.when(known, F.col(term))).over(every)) > 1) & (F.count(F.when(known, 1)).over(every) >= 3)
    return df.withColumn("__u", usable).withColumn("__m", F.avg(value).over(side)).withColumn(value, F.when(known & F.col("__u"), F.col(value) - F.col("__m")).otherwise(F.col(value))).drop("__u", "__m")


def without_heating(df: DataFrame, value: str, months: tuple[int, ...], by: Sequence[str], date: str = "date") -> DataFrame:
    return without_term(df.withColumn("__heating", heating_season(F.col(date), months)), value, "__heating", by).drop("__heating")


def without_terms(df: DataFrame, value: str, terms: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Removes several 0/1 terms at once by least squares."""
    if len(terms) == 1:
        return without_term(df, value, terms[0], by)

    def fit(pdf):
        pdf = pdf[["date"]].assign(**{value: trend.structural_residual(pdf[value].to_numpy(float), pdf[list(terms)].to_numpy(float))})
        return pdf

    return trend.per_series(df, by, fit, f"`date` date, `{value}` double")


def in_interval(df: DataFrame, calendar: DataFrame | None, name: str = "curtailment", date: str = "date") -> DataFrame:
    """1.0 on dates inside an interval, else 0.0; NULL without a calendar."""
    if calendar is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    # intervals become days, so that the join has an equality
    days = calendar.select(F.explode(F.sequence("start", "end")).alias(date)).distinct().withColumn(name, F.lit(1.0))
    return df.join(days, date, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def residual_simple(df: DataFrame, y: str, x: str, by: Sequence[str], name: str = "residual") -> DataFrame:
    """Residual on one covariate, by aggregates alone; the value itself where there are under 3 pairs."""
    w = Window.partitionBy(*by)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n = F.count(a).over(w)
    slope = F.coalesce((F.avg(a * b).over(w) - F.avg(a).over(w) * F.avg(b).over(w)) / F.nullif(F.var_pop(a).over(w), F.lit(0.0)), F.lit(0.0))
    fit = df.withColumn("__n", n).withColumn("__s", slope).withColumn("__mx", F.avg(a).over(w)).withColumn("__my", F.avg(b).over(w))
    residual = F.when(F.col("__n") < 3, F.col(y)).otherwise(F.col(y) - F.col("__my") - F.col("__s") * (F.col(x) - F.col("__mx")))
    return fit.withColumn(name, F.when(both, residual)).drop("__n", "__s", "__mx", "__my")


def linear_trend(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Straight trend over the order of the observed rows: (.., t, trend, residual), without a fit in Python."""
    known = F.when(F.col(value).isNotNull(), 1)
    rank = F.count(known).over(ordered(by).rowsBetween(Window.unboundedPreceding, 0)) - 1
    n = F.count(known).over(Window.partitionBy(*by))
    timed = df.withColumn("t", F.when(F.col(value).isNotNull(), rank / F.nullif(n - 1, F.lit(0))))
    out = residual_simple(timed, value, "t", by)
    return out.withColumn("trend", F.col(value) - F.col("residual"))


def harmonic_one(df: DataFrame, value: str, by: Sequence[str], date: str = "date") -> DataFrame:
    """Removes one annual harmonic by its normal equations, from sums alone (Cramer's rule)."""
    from tephra.functions.calendar import annual_phase

    known = F.col(value).isNotNull()
    phase = annual_phase(F.col(date))
    w = Window.partitionBy(*by)
    timed = df.withColumn("__c", F.when(known, F.cos(phase))).withColumn("__s", F.when(known, F.sin(phase)))
    # about the means, two equations are left
    mean = lambda c: F.avg(c).over(w)
    timed = timed.withColumn("__mc", mean("__c")).withColumn("__ms", mean("__s")).withColumn("__my", mean(value))
    c, s, y = F.col("__c") - F.col("__mc"), F.col("__s") - F.col("__ms"), F.col(value) - F.col("__my")
    for name, e in (("__cc", c * c), ("__ss", s * s), ("__cs", c * s), ("__cy", c * y), ("__sy", s * y)):
        timed = timed.withColumn(name, F.sum(e).over(w))
    det = F.nullif(F.col("__cc") * F.col("__ss") - F.col("__cs") * F.col("__cs"), F.lit(0.0))
    a = (F.col("__cy") * F.col("__ss") - F.col("__sy") * F.col("__cs")) / det
    b = (F.col("__sy") * F.col("__cc") - F.col("__cy") * F.col("__cs")) / det
    enough = F.count(value).over(w) >= 6
    timed = timed.withColumn("__enough", enough)
    out = timed.withColumn("residual", F.when(F.col("__enough"), y - a * c - b * s).otherwise(F.col(value)))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def build_index(df: DataFrame, value: str, by: Sequence[str], anchor: str = "zscore", date: str = "date") -> DataFrame:
    """index_value: z-scores, or percent of the mean over the dates whose text starts with the anchor.

    Without variance z-scores are differences from the mean. A label without dates takes the whole mean; a base of 0
    leaves values as they are.
    """
    w = Window.partitionBy(*by)
    if anchor == "zscore":
        out = df.withColumn("__m", F.avg(value).over(w)).withColumn("__s", F.stddev_pop(value).over(w))
        scaled = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(F.col(value) - F.col("__m"))
    else:
        inside = F.when(F.col(date).cast("string").startswith(anchor), F.col(value))
        out = df.withColumn("__m", F.coalesce(F.avg(inside).over(w), F.avg(value).over(w))).withColumn("__s", F.lit(0.0))
        scaled = F.when(F.col("__m") != 0, F.col(value) / F.col("__m") * 100).otherwise(F.col(value))
    return out.withColumn("index_value", scaled).drop("__m", "__s")
