"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, mixing.

Each stage works on all that its predecessor kept, which run() writes as Parquet and reads again.
An empty table of documents gives an empty result in every stage; NULLs in any column, empty and
very long texts, repeated rows and extra columns pass as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sabitext.llm import common, decontam, minhash, mixing, secret_scan, toxicity
from sabitext.shared import mark, released


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the factorization machine, fitted on the labelled rows, doesn't reject. NULL texts stay."""
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return minhash.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in text and n_chars made to agree."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of tokens, with sources in the target proportions."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: A fitted model, MinHash groups, alignments, normal tails and BPE are beyond DuckDB's SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way goes when its result is written."""
    since = mark(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        released(spark, since, but=1)
    return docs
