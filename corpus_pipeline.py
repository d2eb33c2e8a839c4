"""A corpus from raw documents to shards: quality, near duplicates, benchmark leaks, mixture, placement.

Each stage takes and returns documents; the last adds their place. Between stages the rows are written to the folder
that the cluster shares, so that a lost executor costs the stage it worked on at most. A stage's table is deleted once
the next one's is written; that of the last but one stays, as the result reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tephra.llm import op2_line_frequency, op6_lookup_sharding, op8_poisson_mix, op9_spaced_seeds, op10_jaccard_join
from tephra.llm.shared import remove, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of text and of lines don't reject, without the lines above the limits of their hosts."""
    return op2_line_frequency.keep_cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of five words, similarity 0.8 or more."""
    return op10_jaccard_join.one_of_each(docs, by="root", n_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return op9_spaced_seeds.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in one global order."""
    return op8_poisson_mix.poisson_mix(docs).select(*docs.columns)


def placement(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with slot and shard."""
    return op6_lookup_sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("sharding", placement),
]

#: Components of a similarity join are a closure over all pairs of documents, which SQL can't give on whole tables;
#: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            if before is not None:
                remove(before)
            before = docs
    return docs
