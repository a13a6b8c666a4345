"""Exact deduplication by counting quotient filters, with byte verification of what they count twice."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, cut, release, with_row_key, without_rows

#: Fingerprints that a block of the merged filter holds, about: what one task merges.
BLOCK = 1 << 16
REMAINDER_BITS = 32


class QuotientFilter:
    """A counting quotient filter of 64-bit fingerprints: the upper bits name a bucket, the remainders of a bucket are sorted.

    Held as occupied buckets, their run lengths, the remainders run by run and a count for each remainder. Since nothing
    but the bucket number is taken off a fingerprint, merging two filters loses nothing.
    """

    def __init__(self, buckets: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.buckets, self.lengths, self.remainders, self.counts = buckets, lengths, remainders, counts

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        prints = prints.astype(np.uint64)
        whole, back = np.unique(prints, return_inverse=True)
        total = np.bincount(back, counts, len(whole)).astype(np.int64)
        bucket = (whole >> np.uint64(REMAINDER_BITS)).astype(np.uint32)
        buckets, lengths = np.unique(bucket, return_counts=True)
        return cls(buckets, lengths.astype(np.uint32), (whole & np.uint64((1 << REMAINDER_BITS) - 1)).astype(np.uint32), total)

    def prints(self) -> np.ndarray:
        return (np.repeat(self.buckets, self.lengths).astype(np.uint64) << np.uint64(REMAINDER_BITS)) | self.remainders.astype(np.uint64)

    def _with(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' runs, merged in one pass: the remainders of either stand sorted within their buckets, so the place
        of each in the other follows from a search, and nothing is sorted again. Counts of equal remainders add up."""
        a, b = self.prints(), other.prints()
        at = np.searchsorted(a, b)
        same = at < len(a)
        same[same] = a[at[same]] == b[same]
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]
        new = ~same
        whole, total = np.insert(a, at[new], b[new]), np.insert(counts, at[new], other.counts[new])
        bucket = (whole >> np.uint64(REMAINDER_BITS)).astype(np.uint32)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        return QuotientFilter(bucket[first], np.diff(np.r_[first, len(bucket)]).astype(np.uint32), (whole & np.uint64((1 << REMAINDER_BITS) - 1)).astype(np.uint32), total)

    @classmethod
    def merged(cls, parts: list[QuotientFilter]) -> QuotientFilter:
        """All parts in one, merged two by two: each remainder takes part in as many merges as halving has rounds."""
        while len(parts) > 1:
            parts = [parts[i]._with(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else cls.of(np.zeros(0, np.uint64))

    def to_bytes(self) -> bytes:
        return b"".join([np.array([len(self.buckets), len(self.remainders)], np.uint32).tobytes(), self.buckets.tobytes(), self.lengths.tobytes(), self.remainders.tobytes(), self.counts.astype(np.uint64).tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        b, n = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
        four = np.frombuffer(raw, np.uint32, 2 * b + n, 8)
        return cls(four[:b], four[b : 2 * b], four[2 * b :], np.frombuffer(raw, np.uint64, n, 8 + 4 * (2 * b + n)).astype(np.int64))


def counted_twice(prints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (column print) that occur more than once, with their counts.

    Each partition builds a filter in blocks of bucket ranges; the blocks of all partitions meet by range and merge. How
    many blocks there are follows the number of rows, so that a merge always handles about BLOCK different fingerprints:
    copies within a partition are one remainder with a count.
    """
    bits = max(0, (rows // BLOCK).bit_length())
    shift = np.uint64(64 - bits)

    def build(batches):
        held: list[np.ndarray] = []

        def blocks():
            f = QuotientFilter.of(np.concatenate(held))
            whole = f.prints()
            block = (whole >> shift).astype(np.int64) if bits else np.zeros(len(whole), np.int64)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.r_[starts[1:], len(block)]
            return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array([QuotientFilter.of(whole[a:b], f.counts[a:b]).to_bytes() for a, b in zip(starts, ends)], pa.binary())], names=["block", "filter"])

        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= 1_000_000:
                yield blocks()
                held.clear()
        if sum(map(len, held)):
            yield blocks()

    def merge(pdf):
        f = QuotientFilter.merged([QuotientFilter.from_bytes(x) for x in pdf["filter"]])
        many = f.counts > 1
        return pd.DataFrame({"print": f.prints()[many].view(np.int64), "n": f.counts[many]})

    parts = prints.select("print").mapInArrow(build, "block long, filter binary")
    return parts.groupBy("block").applyInPandas(merge, "print long, n long")


def _squeezed(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and the row's file_key, row_key.

    Texts are equal when the same bytes remain without [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest doc_id (null last), then the first of repeated rows: one row of each
    group is kept. An empty table gives an empty result; other columns are left out.
    """
    return _groups(with_row_key(docs), column_of(docs, id_col), column_of(docs, text_col))


def _groups(keyed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key, text = F.col(id_col), F.col(text_col)
    squeezed = keyed.select("file_key", "row_key", key.cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_points"), _squeezed(text).alias("squeezed"))
    rows = cut(squeezed.select("file_key", "row_key", "doc_id", "n_points", F.sha2("squeezed", 256).alias("text_sha256"), F.xxhash64("squeezed").alias("print")))
    hot = cut(counted_twice(rows, rows.count()).select(F.col("print").alias("hot_print")))

    # Byte verification: the texts behind the fingerprints that are counted more than once, grouped by their bytes.
    texts = squeezed.select("squeezed", F.xxhash64("squeezed").alias("print")).join(hot, F.col("print") == F.col("hot_print"), "left_semi")
    verified = texts.groupBy("squeezed").count().where("count > 1").select(F.sha2("squeezed", 256).alias("of_sha256"), F.col("count").alias("group_size"))

    routed = rows.join(hot, F.col("print") == F.col("hot_print"), "left_semi")
    best = routed.groupBy(F.col("text_sha256").alias("best_sha256")).agg(
        F.count("*").alias("n_rows"),
        F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file_key", "row_key")).alias("best"),
    )
    # A text that shares its digest with other bytes would show here, as a count that differs.
    same = F.when(F.col("n_rows") == F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("long"))
    groups = cut(best.join(verified, F.col("best_sha256") == F.col("of_sha256")).select("best_sha256", same.alias("group_size"), "best"))
    release(hot)

    own = (F.col("best.file_key") == F.col("file_key")) & (F.col("best.row_key") == F.col("row_key"))
    return rows.join(groups, F.col("text_sha256") == F.col("best_sha256"), "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(own, F.lit(True)).alias("kept"),
        "text_sha256",
        "file_key",
        "row_key",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with one row of each group of equal texts (see exact_groups); all columns stay.

    Any frame will do, also one of a join, a union or a generator: its rows are numbered once.
    """
    keyed = with_row_key(docs)
    groups = _groups(keyed, column_of(docs, id_col), column_of(docs, text_col))
    gone = cut(groups.where(~F.col("kept")).select(F.col("file_key").alias("gone_file"), F.col("row_key").alias("gone_row")))
    return without_rows(keyed, gone, docs.columns)
