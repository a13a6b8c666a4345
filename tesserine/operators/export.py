"""Sinks: articles, title map, triplets and key-value items."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).json(path)


def write_json_arrays(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON array in each file, an element a line, characters as they are; an empty partition gives [] or an empty file."""

    def bracketed(batches):
        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [("[" if first and k == 0 else ",") + x for k, x in enumerate(values)]})
            first = first and not values
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    lines.mapInArrow(bracketed, "value string").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def arrays_to_lines(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> DataFrame:
    """The JSON arrays in the files below source, at any depth, as lines; one folder below target for each file.

    Returns one row: n_files, n_skipped (another JSON value than an array), n_broken (no JSON), n_lines. Elements that are
    null are no lines.
    """
    whole = spark.read.option("recursiveFileLookup", "true").text(source, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    relative = F.element_at(F.split("path", re.escape(root) + "/?", 2), -1)
    is_array, rows = F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>")
    files = whole.select(relative.alias("file"), is_array.alias("is_array"), F.when(is_array, rows).alias("rows"), F.get_json_object("value", "$").isNull().alias("no_json"))
    lines = files.where("rows is not null").select("file", F.explode("rows").alias("value")).where("value is not null")
    lines.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("file").text(target)
    broken = F.when(F.col("is_array"), F.col("rows").isNull()).otherwise(F.col("no_json"))
    size = F.coalesce(F.size(F.filter("rows", F.isnotnull)), F.lit(0))
    return files.agg(F.count("*").alias("n_files"), F.count_if(~F.col("is_array") & ~F.col("no_json")).alias("n_skipped"), F.count_if(broken).alias("n_broken"), F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).alias("n_lines"))


def article_titles(articles: DataFrame, order: Column) -> DataFrame:
    """(title, url): for a title that several articles have, the url of the last in order; empty titles have none."""
    return articles.where("title <> ''").groupBy("title").agg(F.max_by("url", order).alias("url"))


def curids(titles: DataFrame) -> DataFrame:
    """(title, curid) of the titles (title, url) whose url names one."""
    return titles.select("title", text.curid(F.col("url")).alias("curid")).where("curid is not null")


def key_values(passages: DataFrame, ids: DataFrame, min_chars: int = DEFAULT.export.min_chars, nested: bool = True, limit: int | None = None) -> DataFrame:
    """passages (idx, article_title, text) with prose (null: dropped) and curid, from which items and counters are made.

    limit: only the passages with the smallest idx, as many, for a trial.
    """
    passages = passages.orderBy("idx").limit(limit) if limit is not None else passages
    known = ids.select(F.col("title").alias("of_title"), "curid")
    found = passages.join(known, F.col("article_title") == F.col("of_title"), "left").drop("of_title")
    return found.withColumn("prose", text.clean_paragraph(F.col("text"), min_chars, nested))


def items(rows: DataFrame) -> DataFrame:
    """(idx, item): the JSON of a typed key-value item for every row that is not dropped; curid only where it is known."""
    number = lambda c: F.struct(F.col(c).cast("string").alias("N"))
    string = lambda c: F.struct(F.col(c).alias("S"))
    item = F.struct(number("idx").alias("idx"), string("prose").alias("text"), string("article_title").alias("title"), F.when(F.col("curid").isNotNull(), number("curid")).alias("curid"))
    return rows.where("prose is not null").select("idx", F.to_json(F.struct(item.alias("Item"))).alias("item"))


def counters(rows: DataFrame) -> DataFrame:
    """One row: n_read, n_written, n_dropped, n_cleaned, n_missing_curid."""
    kept = F.col("prose").isNotNull()
    return rows.agg(F.count("*").alias("n_read"), F.count_if(kept).alias("n_written"), F.count_if(~kept).alias("n_dropped"), F.count_if(kept & (F.col("prose") != F.col("text"))).alias("n_cleaned"), F.count_if(kept & F.col("curid").isNull()).alias("n_missing_curid"))


def write_items(rows: DataFrame, path: str, rows_per_file: int = DEFAULT.export.rows_per_file, overwrite: bool = False) -> None:
    """Gzipped lines in the order of idx, at most so many in a file."""
    lines = items(rows).repartitionByRange("idx").sortWithinPartitions("idx").select("item")
    lines.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", rows_per_file).option("compression", "gzip").text(path)
