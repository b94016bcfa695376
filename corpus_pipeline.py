"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import decontam, mixing, quality, secrets, simhash, similar
from recollect.llm.components import merged_groups
from recollect.session import small_batches, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject; it learns from this stage's own input."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that SimHash links or whose five-word shingles are 0.8 similar, the one with the smallest doc_id.

    Fingerprints within four bits are operator 9's links. The exact similarity adds those between texts
    that differ in more bits; a group may hold links of both kinds.
    """
    small_batches(spark)
    return simhash.keep_one(docs, found=merged_groups(similar.near_duplicates(docs), simhash.near_duplicates(docs)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    small_batches(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with ``copy`` counting from 1; others go."""
    small_batches(spark)
    return mixing.repeat(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("source mixing", mix_sources),
]

#: Fitted rules, fingerprints and random rounding are not for SQL; tests/llm has a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
