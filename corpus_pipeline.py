"""A corpus from documents to training mix; each stage is one operator of ``firegrid.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firegrid.llm import decontaminate, jaccard, mixing, pseudonyms, toxicity
from firegrid.llm.queries import MIX_SEED, PII_KEY
from firegrid.session import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance puts nearer to toxic text go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid personal numbers, dates and addresses become keyed pseudonyms of the same format."""
    return pseudonyms.pseudonymize(docs, PII_KEY, counted=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to equal source weights, in a global random order."""
    return mixing.mix(docs, seed=MIX_SEED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

# trained scores, groups of near copies and keyed pseudonyms have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
