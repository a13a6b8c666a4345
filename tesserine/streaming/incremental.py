"""Incremental processing of article files: a file stream with a checkpoint in place of marker files.

Files that were processed are known from the stream's checkpoint, so a restart goes on where it stopped and inputs are
never renamed. Each batch is cleaned, split, encoded and appended; its rows carry the batch, and a batch that is run again
after a failure replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import passages, storage


def article_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """ARTICLE rows of JSON line files as they come, with broken: the line itself where it is not JSON, else null."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").text(path).where("trim(value) <> ''")
    row = F.from_json("value", schema.ARTICLE + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return lines.select(row.alias("row")).select("row.id", "row.url", "row.title", "row.content", "row.broken")


def passage_batches(stream: DataFrame, out: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame] | None = None):
    """Start writing the passages of a stream of articles to out, partitioned by batch; the query ends when all is read.

    idx goes on from batch to batch without gaps, so the passages can enter an index and a search. `out`-counts has a row
    for each batch: n_lines, n_broken, n_passages. A batch that is run again gives the same numbers again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            earlier = storage.open_table(spark, f"{out}-counts").where(F.col("batch") < number)
            base = earlier.agg(F.coalesce(F.sum("n_passages"), F.lit(0))).first()[0]
        except FileNotFoundError:
            base = 0
        good = batch.where("broken is null").drop("broken").withColumnRenamed("title", "article_title")
        placed = passages.dense_ids(passages.explode_paragraphs(good), ["id", "article_title", "pos", "text"])
        rows = placed.withColumn("idx", F.col("idx") + base)
        (encode(rows) if encode else rows).write.mode("overwrite").parquet(f"{out}/batch={number}")
        told = batch.agg(F.count("*").alias("n_lines"), F.count("broken").alias("n_broken"))
        told.withColumn("n_passages", F.lit(placed.count())).write.mode("overwrite").parquet(f"{out}-counts/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backlink_stream(edges: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Link counts by day of a stream of edges (to_title, seen timestamp); late ones count up to the delay."""
    return edges.withWatermark("seen", delay).groupBy(F.window("seen", window), F.col("to_title").alias("title")).agg(F.count("*").alias("count"))
