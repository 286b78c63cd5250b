"""A training corpus from `documents`: languages, near duplicates, benchmark passages, secrets, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import decontamination, language_id, mixing, secret_scan, simhash_dedup
from roadpulse.llm.frames import table
from roadpulse.session import scratch_path

#: No SQL states a trained filter, a fingerprint or a forest; tests hold the stages against brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those of which no language knows a fifth of the n-grams.

    Rows are judged one by one, whatever their doc_id; repeated rows share their lot. Without any lang all rows go.
    """
    return language_id.in_known_language(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 3-word SimHash fingerprints (2 or fewer differing bits) connect.

    It is the one with the smallest doc_id; rows without doc_id come last, and of wholly equal rows one stays.
    """
    return simhash_dedup.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item; rows are judged one by one. Without items nothing goes."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces confirmed secrets in the texts; no document goes, and rows without or with equal doc_id lose their own."""
    confirmed = secret_scan.scan(docs).where("is_secret = 1")
    clean = secret_scan.redacted(docs, confirmed)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that it takes anything of; a text without words has nothing to take."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("languages", languages), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages),
    ("secrets", secrets), ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
