"""Which texts contain which items, without comparing every text with every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Words of a key. The first and the last word of an item may be cut inside a text's word, so keys are taken between them.
WORDS = 3


def _keys(c: Column) -> Column:
    """Hashes of all runs of WORDS words, in their order."""
    words = F.split(c, r"\s+")
    one = lambda ws, i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(1, WORDS + 1)])
    return let(words, lambda ws: F.when(F.size(ws) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(ws) - WORDS), lambda i: one(ws, i))).otherwise(F.array().cast("array<bigint>")))


def containing(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item) of the texts (key, body) that contain items (item, part), white space and case as they stand; each pair once.

    An item's key is its second to fourth word: a text that contains the item has them as whole words. Texts meet items by
    equal keys, and contains() decides. Items of fewer than WORDS + 2 words have no such key; they are few and short, and
    only if there are any is each text searched for them. Null texts contain nothing; an empty item is in every text.
    """
    own = _keys(F.col("part"))
    keyed = items.select("item", "part", F.try_element_at(own, F.lit(2)).alias("of_key"), (F.size(own) >= 3).alias("long"))
    grams = texts.select("key", F.explode(F.array_distinct(_keys(F.col("body")))).alias("gram"))
    # A text meets an item once at least for each pair of the result, so only pairs and keys are shuffled, and no texts.
    met = grams.join(keyed.where("long").select("item", "of_key"), F.col("gram") == F.col("of_key")).select(F.col("key").alias("met_key"), F.col("item").alias("met_item")).distinct()
    bodies = met.join(texts, F.col("met_key") == F.col("key")).join(items, F.col("met_item") == F.col("item"))
    found = bodies.where(F.contains("body", F.col("part"))).select("key", "item")
    short = keyed.where("not long").select("item", "part")
    if short.isEmpty():
        return found.distinct()
    return found.union(texts.join(short, F.contains("body", F.col("part"))).select("key", "item")).distinct()
