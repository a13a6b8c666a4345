"""Vector indexes as tables: flat search, inverted lists, product quantisation, and their checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import vector as V
from .storage import broadcast_if_small, materialise


class MisalignedIndex(RuntimeError):
    """An index and its passages do not hold the same ids."""


def flat_bytes(rows: int, dim: int) -> int:
    return rows * dim * 4


def index_type(kind: str, rows: int, dim: int, ceiling: int = DEFAULT.index.flat_ceiling_bytes) -> str:
    """flat or ivfpq as asked; auto is flat as long as the vectors fit below the ceiling."""
    if kind in ("flat", "ivfpq"):
        return kind
    if kind != "auto":
        raise ValueError(f"index type {kind!r}")
    return "flat" if flat_bytes(rows, dim) <= ceiling else "ivfpq"


def check_flat(rows: int, dim: int, ceiling: int = DEFAULT.index.flat_ceiling_bytes) -> None:
    if flat_bytes(rows, dim) > ceiling:
        raise ValueError(f"{rows} vectors of {dim} are {flat_bytes(rows, dim)} bytes, over {ceiling}")


def ivf_parameters(rows: int) -> tuple[int, int]:
    """(lists, training vectors)."""
    lists = min(max(int(4 * math.sqrt(rows)), DEFAULT.index.least_lists), DEFAULT.index.most_lists)
    return lists, min(rows, max(100_000, 40 * lists))


def parameters(vectors: DataFrame) -> DataFrame:
    """One row: rows, dim, flat_bytes, index_type, n_lists, n_training of a table (idx, embedding)."""
    size = vectors.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).cast("long").alias("dim"))
    lists = F.least(F.greatest(F.floor(F.lit(4.0) * F.sqrt("rows")), F.lit(DEFAULT.index.least_lists)), F.lit(DEFAULT.index.most_lists))
    return size.select(
        "rows", "dim", (F.col("rows") * F.col("dim") * 4).alias("flat_bytes"),
        F.when(F.col("rows") * F.col("dim") * 4 <= DEFAULT.index.flat_ceiling_bytes, "flat").otherwise("ivfpq").alias("index_type"),
        lists.cast("long").alias("n_lists"), F.least("rows", F.greatest(F.lit(100_000), lists * 40)).cast("long").alias("n_training"),
    )


def inspect(vectors: DataFrame, parts: int = DEFAULT.index.parts, bits: int = DEFAULT.index.bits) -> DataFrame:
    """One row about a table (idx, embedding): its parameters, bytes a vector either way, compression and memory."""
    p = parameters(vectors)
    code = F.lit(parts * bits / 8)
    return p.select("*", (F.col("dim") * 4).alias("flat_vector_bytes"), code.alias("code_bytes"), (F.col("dim") * 4 / code).alias("compression"), F.when(F.col("index_type") == "flat", F.col("flat_bytes").cast("double")).otherwise(F.col("rows") * code * 1.2).alias("memory_bytes"))


def assert_aligned(index: DataFrame, passages: DataFrame) -> None:
    """Both sides hold each idx once, and the same ones; MisalignedIndex otherwise."""
    both = index.groupBy("idx").agg(F.count("*").alias("a")).join(passages.groupBy("idx").agg(F.count("*").alias("b")), "idx", "full")
    bad = both.where("a is null or b is null or a <> 1 or b <> 1").limit(5).collect()
    if bad:
        raise MisalignedIndex(f"idx {[r['idx'] for r in bad]}")


def alignment(index: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: index_rows, passage_rows, only_index, only_passages, aligned."""
    both = index.select("idx", F.lit(1).alias("a"), F.lit(0).alias("b")).union(passages.select("idx", F.lit(0), F.lit(1))).groupBy("idx").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.agg(*[F.coalesce(x, F.lit(0)).alias(n) for n, x in (("index_rows", F.sum("a")), ("passage_rows", F.sum("b")), ("only_index", F.sum(F.when(F.col("b") == 0, F.col("a")))), ("only_passages", F.sum(F.when(F.col("a") == 0, F.col("b")))))]).withColumn("aligned", (F.col("only_index") == 0) & (F.col("only_passages") == 0) & (F.col("index_rows") == F.col("passage_rows")))


def top_by(found: DataFrame, k: int, distance: str = "distance") -> DataFrame:
    """The k nearest of every query (qid) with rank_pos from 0; ties by idx."""
    near = Window.partitionBy("qid").orderBy(distance, "idx")
    # The filter must be on the row number itself: only then does each partition pass on k rows a query.
    return found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k).withColumn("rank_pos", F.col("place") - 1).drop("place")


def search_flat(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, idx, distance, rank_pos): exact squared L2 of queries (qid, vec) against vectors (idx, embedding).

    Every query is compared with every vector; the k best of each partition are all that is shuffled.
    """
    asked = broadcast_if_small(queries.select("qid", "vec"), 10_000)
    found = vectors.join(asked, how="cross").select("qid", "idx", V.l2_squared(F.col("vec"), F.col("embedding")).alias("distance"))
    return top_by(found, k)


def search_blocks(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "l2", block: int = 4096, asked: int = 2048) -> DataFrame:
    """As search_flat, for many queries: blocks of vectors against blocks of queries, as matrix products in Python.

    A task holds one block of each, and passes the k nearest of its block on. Products tell which vectors can be among them
    within rounding; the distances of these are added as search_flat adds them. measure dot: the distance is the negative
    dot product, rounded to 9 places so that equal ones are told as equal whatever the order of the sums.
    """
    n, m = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() // asked))
    # Cogrouped keys aren't cast to one type: an int and a long of one value would go to different partitions and not meet.
    left = vectors.select("idx", "embedding", F.pmod(F.xxhash64("idx"), F.lit(n)).cast("int").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = queries.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(m)).cast("int").alias("b")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def nearest(x, q):
        if not len(x) or not len(q):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "idx": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        a, b = np.stack(x["embedding"]).astype(float), np.stack(q["vec"]).astype(float)
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        near = -np.round(b @ a.T, 9) if measure == "dot" else bb[:, None] - 2 * b @ a.T + aa[None, :]
        ids, out = x["idx"].to_numpy(), []
        last = min(k, len(ids)) - 1
        for i, qid in enumerate(q["qid"]):
            if measure == "dot":
                some, exact = np.arange(len(ids)), near[i]
            else:
                slack = 1e-15 * (a.shape[1] + 3) * (aa + bb[i])  # twice the rounding of both sums at least
                # not beyond, rather than within: what isn't finite stays
                some = np.flatnonzero(~(near[i] - slack > np.partition(near[i] + slack, last)[last]))
                exact = np.cumsum((a[some] - b[i]) ** 2, axis=1)[:, -1]  # in the order of components, as the column functions add
            best = np.lexsort((ids[some], exact))[:k]
            out.append(pd.DataFrame({"qid": qid, "idx": ids[some[best]], "distance": exact[best]}))
        return pd.concat(out)

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(nearest, "qid long, idx long, distance double")
    return top_by(found, k)


# Inverted lists: a table of centroids (list_id, centroid), at most 65,536 rows, and vectors with their list_id.


def _centres(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(list ids, centroids) in the order of list_id, on the driver: at most most_lists rows, or an error."""
    rows = centroids.select("list_id", "centroid").limit(DEFAULT.index.most_lists + 1).toPandas().sort_values("list_id")
    if len(rows) > DEFAULT.index.most_lists:
        raise ValueError(f"over {DEFAULT.index.most_lists} lists")
    return rows["list_id"].to_numpy(np.int64), np.stack(rows["centroid"]).astype(float) if len(rows) else np.zeros((0, 0))


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k nearest centres of each vector, ties to the smaller row.

    A matrix product finds those within rounding of the k nearest; their distances are then worked out component by component.
    """
    near = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    k = min(k, len(centres))
    edge = np.partition(near, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(x), k), np.int64)
    for i, limit in enumerate(edge + 1e-9 * (1 + np.abs(edge))):
        some = np.flatnonzero(near[i] <= limit)
        exact = np.zeros(len(some))
        for part in (centres[some] - x[i]).T:  # in the order of components, as the column functions add
            exact += part * part
        out[i] = some[np.lexsort((some, exact))[:k]]
    return out


def _ranked(vec: Column, centroids: DataFrame, k: int, rows: int = 1024) -> Column:
    """The ids of the k nearest lists of a vector, by blocks of vectors against all centroids, as matrix products."""
    ids, centres = _centres(centroids)
    shared = centroids.sparkSession.sparkContext.broadcast((ids, centres))

    @F.pandas_udf("array<int>")
    def ranked(vectors: pd.Series) -> pd.Series:
        ids, centres = shared.value
        found: list = []
        for at in range(0, len(vectors), rows):
            found += list(ids[_nearest(np.stack(vectors.iloc[at : at + rows]).astype(float), centres, k)].astype(np.int32))
        return pd.Series(found, index=vectors.index, dtype=object)

    return ranked(vec)


def assign_lists(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors with list_id of the nearest centroid, ties to the smaller one."""
    return vectors.withColumn("list_id", _ranked(F.col("embedding"), centroids, 1)[0])


def train_lists(vectors: DataFrame, lists: int, training: int | None = None, seed: int = 42) -> DataFrame:
    """Centroids by k-means over the vectors with the smallest idx, as many as asked for."""
    some = vectors.where(F.col("idx") < training) if training else vectors
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(some.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]  # one row a list
    return vectors.sparkSession.createDataFrame(rows, "list_id int, centroid array<double>")


def probe_lists(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, vec, list_id): the nprobe nearest lists of every query."""
    return queries.select("qid", "vec", _ranked(F.col("vec"), centroids, nprobe).alias("lists")).select("qid", "vec", F.explode("lists").alias("list_id"))


def search_lists(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int = DEFAULT.index.nprobe) -> DataFrame:
    """As search_flat, within the lists that a query probes; only these lists are joined."""
    probes = broadcast_if_small(probe_lists(queries, centroids, nprobe).withColumnRenamed("list_id", "probed"))
    found = assigned.join(probes, F.col("list_id") == F.col("probed")).select("qid", "idx", V.l2_squared(F.col("vec"), F.col("embedding")).alias("distance"))
    return top_by(found, k)


# Product quantisation: a codebook (part, code, centre), parts * 2**bits rows, and codes by idx.


def check_parts(dim: int, parts: int) -> int:
    if dim % parts:
        raise ValueError(f"{parts} parts do not divide {dim} dimensions")
    return dim // parts


def train_codebook(vectors: DataFrame, dim: int, parts: int = DEFAULT.index.parts, codes: int = 1 << DEFAULT.index.bits, training: int | None = None, seed: int = 42) -> DataFrame:
    """k-means of every part of the training vectors."""
    size = check_parts(dim, parts)
    some = vectors.where(F.col("idx") < training) if training else vectors
    some = some.select(F.col("embedding").cast("array<double>").alias("embedding")).cache()
    rows = []
    for j in range(parts):
        model = KMeans(k=codes, seed=seed + j, maxIter=8).fit(some.select(array_to_vector(V.part(F.col("embedding"), j, size)).alias("features")))
        rows += [(j, c, [float(x) for x in centre]) for c, centre in enumerate(model.clusterCenters())]
    some.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "part int, code int, centre array<double>")


def codebook_row(codebook: DataFrame) -> DataFrame:
    """One row `book`: by part and code the centre. parts * 2**bits entries, whatever the corpus."""
    of_part = codebook.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("code", "centre"))).alias("codes"))
    return of_part.agg(F.array_sort(F.collect_list(F.struct("part", "codes"))).alias("book"))


def pq_encode(vectors: DataFrame, codebook: DataFrame, dim: int, parts: int) -> DataFrame:
    """vectors with codes: for each part the nearest centre, ties to the smaller code. The codebook's size is fixed."""
    size = check_parts(dim, parts)
    book = codebook.select("part", "code", "centre").toPandas().sort_values(["part", "code"])
    shared = vectors.sparkSession.sparkContext.broadcast([(g["code"].to_numpy(np.int32), np.stack(g["centre"]).astype(float)) for _, g in book.groupby("part")])

    @F.pandas_udf("array<int>")
    def encoded(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        x = np.stack(rows).astype(float)
        codes = [c[_nearest(x[:, j * size : (j + 1) * size], centres, 1)[:, 0]] for j, (c, centres) in enumerate(shared.value)]
        return pd.Series(list(np.stack(codes, axis=1)), index=rows.index, dtype=object)

    return vectors.withColumn("codes", encoded("embedding"))


def pq_decode(coded: DataFrame, codebook: DataFrame) -> DataFrame:
    """coded (codes, ...) with decoded: the centres of its codes, one after the other."""
    held = coded.join(F.broadcast(codebook_row(codebook)), how="cross")
    return held.withColumn("decoded", F.flatten(F.zip_with("codes", "book", lambda c, p: F.element_at(p["codes"], c + 1)["centre"]))).drop("book")


def _with_lookup(queries: DataFrame, codebook: DataFrame, dim: int, parts: int) -> DataFrame:
    """queries with lookup: for each part the distances of the query's part to all centres."""
    size = check_parts(dim, parts)
    held = queries.join(F.broadcast(codebook_row(codebook)), how="cross")  # one row of fixed size
    return held.withColumn("lookup", F.transform("book", lambda p: F.transform(p["codes"], lambda c: V.l2_squared(F.slice(F.col("vec"), p["part"] * size + 1, F.lit(size)), c["centre"])))).drop("book")


def _of_codes() -> Column:
    """The sum of what lookup holds for codes."""
    return F.aggregate(F.zip_with("codes", "lookup", lambda c, t: F.element_at(t, c + 1)), F.lit(0.0), lambda s, x: s + x)


def search_codes(coded: DataFrame, codebook: DataFrame, queries: DataFrame, k: int, dim: int, parts: int) -> DataFrame:
    """As search_flat, with distances from codes: a query's distances to all centres are looked up and added."""
    asked = broadcast_if_small(_with_lookup(queries, codebook, dim, parts).select("qid", "lookup"))
    return top_by(coded.join(asked, how="cross").select("qid", "idx", _of_codes().alias("distance")), k)


def search_ivfpq(index: DataFrame, centroids: DataFrame, codebook: DataFrame, queries: DataFrame, k: int, dim: int, parts: int, nprobe: int = DEFAULT.index.nprobe, digits: int | None = None) -> DataFrame:
    """As search_flat over an index (list_id, idx, codes): distances from codes, within the lists that a query probes.

    No vector is read. The ids of all lists that are probed come to the driver, at most most_lists numbers, and filter the
    index: one that is stored by list_id is read in these folders only. Queries meet the rows of a list by list_id; what
    each partition passes on is k rows a query. digits: distances are rounded so before ties are broken by idx.
    """
    probes = materialise(probe_lists(queries, centroids, nprobe).select("qid", F.col("list_id").alias("probed")))
    lists = sorted(r[0] for r in probes.select("probed").distinct().collect())
    read = index.where(F.col("list_id").isin(lists)) if lists else index.limit(0)
    asked = _with_lookup(queries, codebook, dim, parts).select(F.col("qid").alias("of_qid"), "lookup")
    wanted = broadcast_if_small(probes.join(asked, F.col("qid") == F.col("of_qid")).select("qid", "probed", "lookup"))
    distance = _of_codes() if digits is None else F.round(_of_codes(), digits)
    return top_by(read.join(wanted, F.col("list_id") == F.col("probed")).select("qid", "idx", distance.alias("distance")), k)
