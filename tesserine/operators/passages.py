"""Passages: paragraphs with dense ids, their batches and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text
from .storage import broadcast_if_small, materialise


def explode_paragraphs(articles: DataFrame, content: str = "content") -> DataFrame:
    """The articles' columns but the content, with pos and text: one row for each paragraph, as it stands."""
    others = [c for c in articles.columns if c != content]
    return articles.select(*others, F.posexplode(text.raw_paragraphs(F.col(content))).alias("pos", "text"))


def dense_ids(df: DataFrame, keys: list[str], partitions: int | None = None, name: str = "idx") -> DataFrame:
    """df with idx 0, 1, ... in the order of keys, which tell rows apart.

    Rows are sorted by ranges, and each range is counted; only the counts of the ranges come together.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = materialise(ranged.withColumns({"of_range": F.spark_partition_id(), "within": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = {r["of_range"]: r["count"] for r in placed.groupBy("of_range").count().collect()}  # one number a range
    before, at = [], 0
    for k in sorted(sizes):
        before.append((k, at))
        at += sizes[k]
    bases = F.broadcast(df.sparkSession.createDataFrame(before, "base_range int, base long"))  # one row a range
    return placed.join(bases, F.col("of_range") == F.col("base_range")).withColumn(name, F.col("base") + F.col("within")).drop("of_range", "within", "base_range", "base")


def batch_manifest(passages: DataFrame, rows: int = DEFAULT.embed.batch_rows) -> DataFrame:
    """(seq, first_idx, row_count) of batches of so many passages by idx."""
    seq = F.floor(F.col("idx") / rows).cast("long")
    return passages.groupBy(seq.alias("seq")).agg(F.min("idx").alias("first_idx"), F.count("*").alias("row_count"))


def lookup(passages: DataFrame, ids: DataFrame) -> DataFrame:
    """The passages whose idx is among ids (idx): repeated ids once, negative and unknown ones not at all."""
    wanted = broadcast_if_small(ids.where("idx >= 0").select(F.col("idx").alias("wanted")).distinct())
    return passages.join(wanted, F.col("idx") == F.col("wanted"), "left_semi")
