"""The corpus pipeline: documents in, a mixed training set out; each stage is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evisift.llm import decontaminate, mixture, neardup, resample, secrets
from evisift.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; the others go."""
    return docs.filter(resample.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))[1])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at a similarity of 0.8 on shingles of five words."""
    return neardup.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.filter(decontaminate.is_clean(docs["text"].cast("string"), benchmark))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each copy of a document that the mix takes."""
    return mixture.draw(docs)


STAGES = [
    ("quality_classifier", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("source_mix", source_mix),
]
# The stages fit models and round at random, which SQL doesn't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
