"""The corpus pipeline: each stage works on all that the stage before it kept.

toxicity drops rejected documents, exact_dedup keeps one of each group of equal texts, simhash one of each near-duplicate
component, secrets replaces secrets in the texts, and packing deals the texts out to training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm import exact_dedup, packing, secrets, simhash, toxicity
from tesserine.llm.common import cut
from tesserine.llm.queries import TOKENIZER
from tesserine.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: No SQL: stages learn from labels and hash word shingles; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
