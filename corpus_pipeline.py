"""Corpus pipeline over ``documents``: quality rules, exact dedup, near dedup, redaction of secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last returns
the packed pieces. A stage's result is written as Parquet and read again as the next one's input. Nulls, empty tables, repeated rows and
extra columns are handled as the operators' docstrings say; extra columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bin_packing, exact_dedup, quality_rules, secret_scan, wide_simhash
from spindrift.llm.common import scratch, shared_dir, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.deduplicated(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (pairs of a five-word Jaccard similarity of 0.8 or more) the row with the smallest doc_id."""
    return wide_simhash.one_per_group(docs, distance=56, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return bin_packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: Tokens and fingerprints have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
