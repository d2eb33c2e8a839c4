"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A source of n documents and target weight w has the mean repetition rate total * w / sum(w) / n. Each document draws a
count from the Poisson distribution of that mean by inverting it at a number that its id and the seed hash to, is
repeated so often, and all copies are put into one global order by another hash. The same seed gives the same mix on
any cluster. Without given weights a source weighs the power `temper` of its documents, so that large sources give
way to small ones; `total` is the expected number of rows, by default that of the input.

Rates are one row for each source. Up to BROADCAST_SOURCES of them are broadcast, counted first; beyond that they
are joined with SALTS copies of each, so that a source with a third of all rows goes to SALTS tasks.

Up to a rate of DIRECT_RATE the distribution starts at count 0 with exp(-rate); beyond, it starts 12 standard deviations
below the rate, as multiples of its first term divided by their sum, so no rate underflows and every rate is served.

The order is that of a hash, which spreads evenly: equal ranges of it are the partitions, and each is sorted. No sample
of the keys is taken, so rows are drawn and moved once.

A null source and '' are one source. Sources without a given weight, or with a weight that isn't above 0, are left
out, as are given sources without documents. Rows that repeat a doc_id draw alike. A null doc_id draws as ''. An empty
table stays empty. Columns of the input named `copy_no` or `shuffle_key` are replaced; all others are carried along,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm.hashing import BITS, number, number_sql
from tephra.llm.shared import spread

SEED, TEMPER = "mix-1", 0.5
BROADCAST_SOURCES, SALTS = 20_000, 64
#: Rates up to this have a Poisson distribution that doubles hold from count 0 on.
DIRECT_RATE = 500
ROW, SOURCE = "_mix_row", "_mix_source"


def rates(docs: DataFrame, weights: DataFrame | None, source: str, temper: float, total: int | None, most_rate: float | None = None) -> DataFrame:
    """(source, least, cdf): the distribution of each source from the count `least` on, up to where it is 1."""
    named = lambda df: F.coalesce(df[f"`{source}`"].cast("string"), F.lit("")).alias(SOURCE)
    sizes = docs.groupBy(named(docs)).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temper))))
    else:
        given = weights.groupBy(named(weights)).agg(F.max("weight").cast("double").alias("w"))
        weighed = sizes.join(given.where(F.col("w") > 0), SOURCE)
    all_of = weighed.agg(F.sum("w").alias("all"), F.sum("n").alias("rows"))
    rate = (F.lit(float(total)) if total is not None else F.col("rows")) * F.col("w") / F.col("all") / F.col("n")
    out = weighed.crossJoin(F.broadcast(all_of)).select(SOURCE, rate.alias("rate"))  # one row on the right
    if most_rate is not None:
        checked = F.when(F.col("rate") <= most_rate, F.col("rate")).otherwise(F.raise_error(F.concat(F.lit("rate over the most allowed for source "), F.col(SOURCE))).cast("double"))
        out = out.withColumn("rate", checked)
    # terms until the rest is far below 2 ** -BITS
    reach = 12 * F.sqrt("rate") + 30
    high = F.col("rate") > DIRECT_RATE
    out = out.withColumn("least", F.when(high, (F.col("rate") - reach).cast("long")).otherwise(F.lit(0).cast("long")))
    counts = F.sequence("least", (F.col("rate") + reach).cast("long"))
    step = lambda a, k: F.struct((a["term"] * F.col("rate") / (k + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum"), F.concat(a["cdf"], F.array(a["sum"] + a["term"])).alias("cdf"))
    # beyond DIRECT_RATE exp(-rate) may be 0: terms are multiples of the least one, and their sum stands for 1
    start = F.struct(F.when(high, F.lit(1.0)).otherwise(F.exp(-F.col("rate"))).alias("term"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))
    cdf = F.aggregate(counts, start, step, lambda a: F.when(high, F.transform(a["cdf"], lambda c: c / a["sum"])).otherwise(a["cdf"]))
    return out.select(SOURCE, "least", cdf.alias("cdf"))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", *, seed: str = SEED, temper: float = TEMPER, total: int | None = None, broadcast_sources: int = BROADCAST_SOURCES, salts: int = SALTS, most_rate: float | None = None) -> DataFrame:
    """Copies of the rows of `docs` in global order, with copy_no (from 1) and shuffle_key. weights: (source, weight).

    most_rate: refuses a source with a larger mean repetition, if given.
    """
    by_source = rates(docs, weights, source, temper, total, most_rate)
    # the row travels as one struct, so that no name of its columns can clash
    columns = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    own = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(ROW), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias(SOURCE), F.col(f"`{doc_id}`").alias("id"))
    if own.select(SOURCE).distinct().limit(broadcast_sources + 1).count() <= broadcast_sources:
        drawn = own.join(F.broadcast(by_source), SOURCE)
    else:
        own = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        drawn = own.join(by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), [SOURCE, "salt"])
    drawn = drawn.withColumn("u", number(F.lit(seed), F.col("id")) / float(1 << BITS))
    count = (F.col("least") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).cast("int")
    copies = drawn.select(ROW, "id", count.alias("count")).where(F.col("count") > 0).select(ROW, "id", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy_no"))
    copies = copies.withColumn("shuffle_key", number(F.lit(seed), F.lit("order"), F.col("id"), F.col("copy_no")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor(F.col("shuffle_key") / float(1 << BITS) * parts).cast("int"), F.lit(parts - 1))
    return copies.repartitionById(parts, place).sortWithinPartitions("shuffle_key", "id", "copy_no").select(f"{ROW}.*", "copy_no", "shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH s AS (SELECT coalesce(source, '') AS k, count(*) AS n, pow(count(*)::DOUBLE, {TEMPER}) AS w FROM documents GROUP BY 1),
r AS (SELECT k, (sum(n) OVER ())::DOUBLE * w / (sum(w) OVER ()) / n AS rate FROM s),
p AS (SELECT k, i, exp(-rate) * list_product(list_transform(range(1, i + 1), lambda j: rate / j) || [1.0::DOUBLE]) AS p FROM r, unnest(range(0, CAST(floor(rate + 12 * sqrt(rate) + 30) AS INT) + 1)) t(i)),
c AS (SELECT k, sum(p) OVER (PARTITION BY k ORDER BY i) AS c FROM p),
u AS (SELECT *, {number_sql(f"'{SEED}'", "doc_id")} / {float(1 << BITS)} AS u FROM documents),
m AS (SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM c WHERE c.k = coalesce(u.source, '') AND c.c <= u.u) AS n FROM u)
SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no, {number_sql(f"'{SEED}'", "'order'", "doc_id", "copy_no")} AS shuffle_key FROM m, unnest(range(1, n + 1)) t(copy_no)
"""
