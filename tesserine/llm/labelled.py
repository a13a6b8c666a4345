"""Labelled training rows: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, release


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def teaching_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, label, half) of at most `most` labelled rows whose remainder is not held_out, the first by a hash of doc_id.

    Texts of any length teach, whole. They stay in the shared folder and are measured where they are; what comes to the
    driver is what the caller makes of them. Labels of a repeated doc_id count as 1 if any is; null labels, ids and texts
    teach nothing; a repeated document teaches once. half, 0 or 1, deals the rows out for cross-fitting.
    """
    rows = pick(labels, doc_id="doc_id", label=label).where("doc_id is not null and label is not null")
    rows = rows.where(remainder(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    order = F.xxhash64(F.lit(label), "doc_id")
    some = cut(rows.orderBy(order, "doc_id").limit(most).select(F.col("doc_id").alias("of_id"), "label"))
    texts = pick(docs, doc_id="doc_id", text="text").where(F.col("text").isNotNull())
    # `some` has at most `most` rows of two numbers: a proven bound.
    found = texts.join(F.broadcast(some), F.col("doc_id") == F.col("of_id")).select("doc_id", "text", "label").dropDuplicates(["doc_id"])
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    held = cut(found.select(F.col("doc_id").cast("long"), "text", "label", half.alias("half")))
    release(some)
    return held
