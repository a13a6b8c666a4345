"""Link graph and backlinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def edges(pages: DataFrame, page_links: DataFrame, link_targets: DataFrame) -> DataFrame:
    """(from_title, to_title): links whose page and target are both known, one row for each occurrence."""
    joined = page_links.join(pages, F.col("from_id") == F.col("page_id")).join(link_targets, F.col("to_id") == F.col("lt_id"))
    return joined.select(F.col("title").alias("from_title"), F.col("lt_title").alias("to_title"))


def adjacency(edge: DataFrame) -> DataFrame:
    """(from_title, linked_titles): sorted, repeated targets kept."""
    return edge.groupBy("from_title").agg(F.sort_array(F.collect_list("to_title")).alias("linked_titles"))


def unique_adjacency(lists: DataFrame, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(one list for each title, the first in order; one row `skipped`: how many others there were)."""
    key = order if order is not None else F.to_json("linked_titles")
    first = lists.groupBy("from_title").agg(F.min_by("linked_titles", key).alias("linked_titles"), F.count("*").alias("n"))
    return first.select("from_title", "linked_titles"), first.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("skipped"))


def outlinks(titles: DataFrame, lists: DataFrame) -> DataFrame:
    """titles (title) with linked_titles as a set; empty for a title without links."""
    found = titles.join(lists.withColumnRenamed("from_title", "of_title"), F.col("title") == F.col("of_title"), "left").drop("of_title")
    return found.withColumn("linked_titles", F.array_sort(F.array_distinct(F.coalesce("linked_titles", F.array().cast("array<string>")))))


def backlink_counts(edge: DataFrame) -> DataFrame:
    """(title, count): how often a title is linked to; titles that never are have no row."""
    return edge.groupBy(F.col("to_title").alias("title")).agg(F.count("*").alias("count"))


def backlink_counts_of_lists(lists: DataFrame) -> DataFrame:
    return backlink_counts(lists.select(F.explode("linked_titles").alias("to_title")))


def top_percentile(counts: DataFrame, share: float = 0.01) -> DataFrame:
    """One row max_backlinks: the count at position floor(n * share), from 0, of the counts in descending order; none: 1.

    The sorted list is held as one row for each different count, of which there are few however many titles.
    """
    groups = counts.groupBy("count").agg(F.count("*").alias("n"))
    running = Window.orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    placed = groups.select("count", F.sum("n").over(running).alias("to"), F.sum("n").over(total).alias("all"))
    return placed.where(F.col("to") > F.floor(F.col("all") * F.lit(share))).agg(F.coalesce(F.max("count"), F.lit(1)).cast("long").alias("max_backlinks"))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (title, ...) with backlinks: the title's count, or 0."""
    found = counts.select(F.col("title").alias("of_title"), F.col("count").alias("backlinks"))
    return rows.join(found, F.col("title") == F.col("of_title"), "left").drop("of_title").withColumn("backlinks", F.coalesce("backlinks", F.lit(0)))
