"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are dealt into index segments of about SEGMENT rows. A segment keeps PROJECTIONS sorted arrays, each the values of
one random projection. A query opens a window around its own value in every array; a vector that falls into the window of
at least THRESHOLD of the arrays is a candidate. Virtual rehashing widens the windows, counting only what is new, until
a segment has enough candidates; these are verified by their cosine in double precision. The best of all segments are a
query's neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, cut, with_row_key

PROJECTIONS = 64
#: Arrays in whose windows a candidate must be.
THRESHOLD = 48
SEGMENT, QUERIES = 8192, 1024
#: A segment stops widening when it has verified this share of its vectors and at least LEAST of them.
SHARE, LEAST = 0.1, 128
#: The narrowest half-width, in standard deviations of the projected values, and how it grows. A segment starts its
#: windows where a few of its own vectors, asked as queries, find what is wanted.
FIRST, GROWTH, ASKED = 0.2, 1.06, 8


def directions(dim: int, n: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    """Random directions, in orthogonal groups of dim, so that the windows of a group say different things."""
    r = np.random.default_rng(seed)
    blocks = [np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(-(-n // dim))]
    return np.concatenate(blocks, axis=1)[:, :n]


class Segment:
    """The sorted arrays of one segment of unit vectors."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.to = directions(unit.shape[1])
        values = unit @ self.to
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(values, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)
        self.width = np.maximum(values.std(axis=0), 1e-12)
        self.first: float | None = None

    def _windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows around the projected queries begin and end in each array."""
        lo, hi = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for j, column in enumerate(self.sorted):
            lo[:, j] = np.searchsorted(column, at[:, j] - half * self.width[j], side="left")
            hi[:, j] = np.searchsorted(column, at[:, j] + half * self.width[j], side="right")
        return lo, hi

    def _times(self, parts: list[tuple[int, int, int]]) -> np.ndarray:
        """How often each row stands in the parts (array, from, to)."""
        return np.bincount(np.concatenate([self.order[j, a:b] for j, a, b in parts]), minlength=len(self.unit))

    def _collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many windows each row stands; counted from what is smaller, the windows or what is outside them."""
        n, m = len(self.unit), len(self.sorted)
        if 2 * (hi - lo).sum() <= n * m:
            return self._times(list(zip(range(m), lo, hi)))
        return m - self._times([(j, 0, a) for j, a in enumerate(lo)] + [(j, b, n) for j, b in enumerate(hi)])

    def _start(self, want: int, least: int) -> float:
        if self.first is None:
            at = self.unit[:: max(1, len(self.unit) // ASKED)][:ASKED] @ self.to
            half = FIRST
            while True:
                lo, hi = self._windows(at, half)
                hits = [(self._collisions(a, b) >= least).sum() for a, b in zip(lo, hi)]
                if np.median(hits) >= want:
                    break
                half *= GROWTH
            self.first = half
        return self.first

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query (unit vectors) the rows of the segment that collide often enough, at least k of them if there are."""
        n, m = len(self.unit), len(self.sorted)
        want = min(n, max(LEAST, int(SHARE * n), 4 * k))  # a small segment widens until all of it collides
        at, least = queries @ self.to, min(THRESHOLD, m)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        half = self._start(want, least)
        lo, hi = self._windows(at, half)
        counts = {q: self._collisions(lo[q], hi[q]) for q in range(len(queries))}
        while True:
            for q in list(counts):
                if (found := np.flatnonzero(counts[q] >= least)).size >= want:
                    out[q] = found
                    del counts[q]
            if not counts:
                return out
            half *= GROWTH
            left = np.array(list(counts))
            new_lo, new_hi = self._windows(at[left], half)
            for q, a, b in zip(left.tolist(), new_lo, new_hi):
                parts = [(j, a[j], lo[q, j]) for j in range(m)] + [(j, hi[q, j], b[j]) for j in range(m)]
                counts[q] = counts[q] + self._times(parts)
                lo[q], hi[q] = a, b


def _valid(vector: F.Column) -> F.Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score (the cosine).

    All rows but the query's own take part, rows with the same id or vector included; ties go to the smaller vec_id, null
    last. Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of another
    dimension than the query's. Rows with null id are no queries. An empty table gives an empty result.
    """
    keyed = with_row_key(vectors)
    vector = F.transform(F.col(column_of(vectors, vector_col)), lambda x: x.cast("double"))
    own_id = F.col(column_of(vectors, id_col)).cast("long")
    # A null id is a flag beside a number: a column of whole numbers with nulls would reach Python as doubles.
    rows = keyed.select(F.coalesce(own_id, F.lit(0)).alias("vec_id"), own_id.isNull().alias("no_id"), vector.alias("vector"), "file_key", "row_key")
    rows = cut(rows.where(_valid(F.col("vector"))).withColumn("dim", F.size("vector")))
    queries = rows.where(~F.col("no_id") & (F.col("vec_id") % every == 0))
    segments = max(1, -(-rows.count() // SEGMENT))
    groups = max(1, -(-queries.count() // QUERIES))
    deal = F.xxhash64("file_key", "row_key")
    left = rows.withColumn("segment", F.pmod(deal, F.lit(segments)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.drop("no_id").withColumn("part", F.pmod(deal, F.lit(groups)).cast("int")).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    out = "query_id long, query_file long, query_row long, vec_id long, no_id boolean, score double, file_key long, row_key long"
    kinds = {"long": "int64", "double": "float64", "boolean": "bool"}
    fields = {n: kinds[k] for n, k in (x.split(" ") for x in out.split(", "))}

    def search(index, asked):
        if not len(index) or not len(asked):
            return pd.DataFrame({n: pd.Series(dtype=k) for n, k in fields.items()})
        x, q = np.stack(index["vector"].to_numpy()), np.stack(asked["vector"].to_numpy())
        norm, own = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        found = Segment(x / norm[:, None]).candidates(q / own[:, None], k + 1)
        ids, no_id, files, places = (index[c].to_numpy() for c in ("vec_id", "no_id", "file_key", "row_key"))
        picked, of, scores = [], [], []
        for i, (file, place) in enumerate(zip(asked["file_key"], asked["row_key"])):
            c = found[i]
            c = c[(files[c] != file) | (places[c] != place)]
            cosine = (x[c] * q[i]).sum(axis=1) / (norm[c] * own[i])
            best = np.lexsort((ids[c], no_id[c], -cosine))[:k]
            picked.append(c[best])
            of.append(np.full(len(best), i))
            scores.append(cosine[best])
        j, i = np.concatenate(picked), np.concatenate(of)
        name, file, place = (asked[c].to_numpy()[i] for c in ("vec_id", "file_key", "row_key"))
        return pd.DataFrame(dict(zip(fields, (name, file, place, ids[j], no_id[j], np.concatenate(scores), files[j], places[j]))))

    by = ["dim", "segment", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, out)
    # k rows for each segment at most meet in a query's window.
    best = Window.partitionBy("query_file", "query_row", "query_id").orderBy(F.col("score").desc(), "no_id", "vec_id", "file_key", "row_key")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score")
