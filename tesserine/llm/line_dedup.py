"""Cross-site boilerplate removal: how many sites a line stands on, by HyperLogLog sketches. All in the JVM.

A sketch of the sites is kept for each line hash; sketches merge by aggregation, within partitions first, so a line that
stands everywhere is one small row for each partition. Lines whose estimate is clearly above the threshold are taken and
those clearly below it are not; lines near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, cut, with_row_key

#: A line on so many sites is boilerplate.
MIN_SITES = 5
#: Sketch size: 2**8 registers, a standard error of about 6.5 % once the sketch no longer lists its values.
LOG_K = 8
#: Estimates within this factor of the threshold are counted exactly: over four standard errors.
MARGIN = 1.3
_SPACE = " \t\n\x0b\x0c\r"
#: log2 of the bits of the filter that tells documents without boilerplate: 128 KB, whatever the corpus.
FILTER_BITS = 20


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n only; what stands around a line is kept."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    """A line without white space around it; lines are compared so."""
    return F.btrim(line, F.lit(_SPACE))


def spread_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(hash, sites): hashes of the non-empty lines that stand on at least min_sites sites; a null site is none.

    sites is exact near the threshold and an estimate above it.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, site = F.col(column_of(docs, text_col)), F.col(column_of(docs, site_col))
    seen = plain.where(site.isNotNull()).select(site.alias("site"), F.explode(F.array_distinct(F.transform(lines_of(text), bare))).alias("line")).where("line <> ''")
    hashed = seen.select(F.xxhash64("line").alias("hash"), F.xxhash64("site").alias("site"))
    # A line on min_sites sites occurs as often at least: one count for each line sends most lines no further.
    often = cut(hashed.groupBy("hash").count().where(F.col("count") >= min_sites).select(F.col("hash").alias("often")))
    repeated = hashed.join(often, F.col("hash") == F.col("often"), "left_semi")
    sketched = repeated.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch")).select("hash", F.hll_sketch_estimate("sketch").alias("sites"))
    wide = cut(sketched.where(F.col("sites") >= min_sites / MARGIN))
    near = wide.where(F.col("sites") <= min_sites * MARGIN).select(F.col("hash").alias("near"))
    exact = repeated.join(near, F.col("hash") == F.col("near"), "left_semi").distinct().groupBy("hash").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return wide.where(F.col("sites") > min_sites * MARGIN).unionByName(exact)


def _filter_of(hashes: DataFrame) -> DataFrame:
    """One row (always, words): a bit for each of the values that the hashes have modulo 2**FILTER_BITS, 64 to a word."""
    bit = F.pmod(F.col("drop"), F.lit(1 << FILTER_BITS))
    filled = hashes.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(drop, {1 << FILTER_BITS}) & 63 as int))").alias("mask"))
    every = hashes.sparkSession.range(1 << (FILTER_BITS - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = filled.union(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    # 2**(FILTER_BITS - 6) words, whatever the input.
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words")).withColumn("always", F.lit(1))


def strip_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs as columns c0, c1, ..., with n_lines, n_removed and clean: the text without lines that stand on many sites.

    Null text counts as empty: one line, none removed. Lines in a null site's documents are removed like any others.
    Lines of white space alone always stay; an empty table gives an empty result. Documents that a small bit filter shows
    to hold no boilerplate pass without a shuffle; the others' lines are looked up exactly.
    """
    drop = cut(spread_lines(docs, text_col, site_col, min_sites).select(F.col("hash").alias("drop")))
    keyed = with_row_key(docs)
    own = [c for c in keyed.columns if c not in ("file_key", "row_key")]
    text = F.col(column_of(docs, text_col))
    hashes = F.filter(F.transform(lines_of(text), lambda x: F.when(bare(x) != "", F.xxhash64(bare(x)))), lambda x: x.isNotNull())
    # The filter is one row of fixed size: a proven bound.
    asked = keyed.withColumn("one", F.lit(1)).join(F.broadcast(cut(_filter_of(drop))), F.col("one") == F.col("always"), "left")
    word = lambda h: F.element_at("words", F.shiftright(F.pmod(h, F.lit(1 << FILTER_BITS)), 6).cast("int") + 1)
    told = F.exists(hashes, lambda h: F.getbit(word(h), F.pmod(h, F.lit(64)).cast("int")) == 1)
    clear = asked.where(~told).select(*own, F.size(lines_of(text)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.coalesce(text, F.lit("")).alias("clean"))
    doubted = asked.where(told).select(*own, "file_key", "row_key")
    split = doubted.select("file_key", "row_key", F.explode(hashes).alias("hash"))
    hits = split.join(drop, F.col("hash") == F.col("drop"), "left_semi").groupBy(F.col("file_key").alias("hit_file"), F.col("row_key").alias("hit_row")).agg(F.collect_set("hash").alias("hits"))
    rows = doubted.join(hits, (F.col("file_key") == F.col("hit_file")) & (F.col("row_key") == F.col("hit_row")), "left")
    lines = lines_of(text)
    kept = F.filter(lines, lambda x: (bare(x) == "") | ~F.array_contains("hits", F.xxhash64(bare(x))))
    kept = F.when(F.col("hits").isNull(), lines).otherwise(kept)
    return clear.union(rows.select(*own, F.size(lines).cast("long"), (F.size(lines) - F.size(kept)).cast("long"), F.array_join(kept, "\n")))
