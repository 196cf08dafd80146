"""A training corpus from raw documents: good ones stay, near copies and benchmark leaks go,
secrets are redacted, and the rest is mixed by source. Every stage works on all rows that
the one before it kept.

All stages take nulls in any column, empty and very long texts, repeated rows and empty tables, and
keep extra columns; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import decontamination, jobs, mixing, near_dedup, quality_classifier, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores under its threshold go. A null text is scored as an
    empty one, and equal rows get equal scores."""
    jobs.prepare(spark)
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least id, null last, then of the
    least text hash. Rows without words are copies of nothing and all stay."""
    jobs.prepare(spark)
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; empty texts and items overlap nothing."""
    jobs.prepare(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes, and a null text stays null."""
    jobs.prepare(spark)
    return secret_scan.redact(docs, secret_scan.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each slot of each shard, with its block's text. Repeated rows are documents of
    their own; documents without words are in no block."""
    jobs.prepare(spark)
    return mixing.assemble(docs, *mixing.mix(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: The classifier, the network and the draws can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = jobs.stored(docs)
    return docs
