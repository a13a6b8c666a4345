"""Readers of articles, markup fragments, SQL dumps, test queries and triplets."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, Extract
from ..functions import text

#: Tuples of the three dumps, a page with its whole title, and links of raw pages.
PAGE_TUPLE = r"\((\d+),\d+,'(.*?)',"
WHOLE_PAGE_TUPLE = r"\((\d+),\d+,'((?:[^'\\]|\\.)*)',"
LINK_TUPLE = r"\((\d+),0,(\d+)\)"
TARGET_TUPLE = r"\((\d+),\d+,'(.*?)'\)"
HREF = 'href="/([^"]*)"'


def read_fragments(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """FRAGMENT rows of the <doc> elements in the files below a path, at any depth, with file_path.

    strict: a file that is not well-formed gives nothing at all, and the body ends at the first child element; the file is
    parsed in Python, one at a time. Otherwise elements are found by pattern in the JVM, and a broken one costs no other.
    """
    if not strict:
        whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
        docs = whole.select("file_path", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<doc\b[^>]*>.*?</doc>"), F.lit(0))).alias("doc"))
        attribute = lambda name: text.decode_entities(F.nullif(F.regexp_extract("doc", rf'^<doc\b[^>]*?\b{name}="([^"]*)"', 1), F.lit("")), common=True)
        body = text.decode_entities(F.regexp_extract("doc", r"(?s)^<doc\b[^>]*>([^<]*)", 1), common=True)
        return docs.select(attribute("id").alias("id"), attribute("url").alias("url"), attribute("title").alias("title"), text.strip(body).alias("raw"), "file_path")

    def parse(batches):
        for files in batches:
            rows = []
            for path, content in zip(files["path"], files["content"]):
                try:
                    root = ET.fromstring(b"<root>" + bytes(content) + b"</root>")
                except ET.ParseError:
                    continue
                rows += [(d.get("id"), d.get("url"), d.get("title"), (d.text or "").strip(), path) for d in root.findall("doc")]
            yield pd.DataFrame(rows, columns=["id", "url", "title", "raw", "file_path"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(parse, schema.FRAGMENT + ", file_path string")


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path of the files that are not well-formed."""

    def parse(batches):
        for files in batches:
            bad = []
            for at, content in zip(files["path"], files["content"]):
                try:
                    ET.fromstring(b"<root>" + bytes(content) + b"</root>")
                except ET.ParseError:
                    bad.append(at)
            yield pd.DataFrame({"file_path": bad}, dtype="str")

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(parse, "file_path string")


def articles(fragments: DataFrame, settings: Extract = DEFAULT.extract, common_entities: bool = False, nested: bool = True) -> DataFrame:
    """ARTICLE rows: lines cleaned, the leading title and short or furniture lines dropped, then articles with too few words."""
    lines = text.body_lines(text.clean_text(F.coalesce("raw", F.lit("")), common_entities), F.col("title"))
    # Row-local: Python takes the lines of an article as one array, and no line leaves its row. What a generator gives is
    # worked out once; a plain column would be put into each of the places that name it.
    split = fragments.select("id", "url", "title", F.explode(F.array(lines)).alias("lines"))
    split = split.withColumn("bare", text.drop_spans_each(F.col("lines")) if nested else F.col("lines"))
    content = text.join_paragraphs(text.clean_paragraphs(F.col("lines"), F.col("bare"), settings.min_paragraph_chars))
    # A filter on the content would be pushed below it, too.
    long = F.filter(F.array(content), lambda c: text.word_count(c) >= settings.min_article_words)
    return split.select("id", "url", "title", F.explode_outer(long).alias("content")).where("content is not null")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """ARTICLE rows of files that hold one JSON array each, at any depth; the schema is given, so nothing is read twice."""
    return spark.read.schema(schema.ARTICLE).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def read_article_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ARTICLE rows of JSON lines, lines that are not JSON)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where("trim(value) <> ''")
    row = F.from_json("value", schema.ARTICLE + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.select("value", row.alias("row"))
    good = rows.where("row.broken is null").select("row.id", "row.url", "row.title", "row.content")
    return good, rows.where("row.broken is not null").select(F.col("value").alias("broken"))


def read_test_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, relevant_articles) of one JSON array, numbered in its order."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", F.lit(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.TEST_QUERY.split(', '))}>>")).alias("rows"))
    return whole.select(F.posexplode("rows").alias("qid", "row")).select(F.col("qid").cast("long").alias("qid"), "row.query", "row.relevant_articles")


def read_triplets(spark: SparkSession, path: str, holdout_files: int = 3, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, held out): anchor, positive, negative; the first files by name are held out, but never all of them.

    The number of files, not of rows, comes to the driver. With a seed the training rows are dealt out at random.
    """
    rows = spark.read.schema(schema.TRIPLET).json(path).select("anchor", "positive", "negative", F.col("_metadata.file_path").alias("file_path"))
    files = sorted(r[0] for r in rows.select("file_path").distinct().collect())
    if not files:
        raise ValueError(f"no triplets at {path}")
    held = files[: min(holdout_files, len(files) - 1)]
    inside = F.col("file_path").isin(held) if held else F.lit(False)
    train = rows.where(~inside).drop("file_path")
    return train.orderBy(F.rand(seed)) if seed is not None else train, rows.where(inside).drop("file_path")


def insert_lines(spark: SparkSession, path: str) -> DataFrame:
    """The INSERT lines (line) of a SQL dump, compressed or not."""
    return spark.read.text(path).select(F.col("value").alias("line")).where(F.col("line").startswith("INSERT INTO"))


def _tuples(lines: DataFrame, pattern: str, *columns: Column) -> DataFrame:
    """One row for each match of a pattern; the columns are made of its groups g1, g2."""
    groups = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("g1"), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("g2"))
    return lines.where(F.col("line").startswith("INSERT INTO")).select(F.explode(groups).alias("t")).select("t.g1", "t.g2").select(*columns)


def _title(c: str) -> Column:
    return F.replace(text.sql_unescape(F.col(c)), F.lit("_"), F.lit(" "))


def parse_pages(lines: DataFrame, whole_titles: bool = False) -> DataFrame:
    """(page_id, title) of page tuples in any namespace. A title ends at the first ',: one that holds \\', is cut there,
    unless whole_titles asks for titles as they were written."""
    return _tuples(lines, WHOLE_PAGE_TUPLE if whole_titles else PAGE_TUPLE, F.col("g1").cast("long").alias("page_id"), _title("g2").alias("title"))


def parse_page_links(lines: DataFrame) -> DataFrame:
    """(from_id, to_id) of links from namespace 0."""
    return _tuples(lines, LINK_TUPLE, F.col("g1").cast("long").alias("from_id"), F.col("g2").cast("long").alias("to_id"))


def parse_link_targets(lines: DataFrame) -> DataFrame:
    """(lt_id, lt_title); the namespace is not kept."""
    return _tuples(lines, TARGET_TUPLE, F.col("g1").cast("long").alias("lt_id"), _title("g2").alias("lt_title"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, target) of the href attributes of raw HTML pages, in their order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "target"))
