"""Frames that are no bare scans: rows of a generator, a join, a union or a repartition, through everything that tells rows apart."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserine.llm import common, exact_dedup, neighbours, simhash, toxicity

from .conftest import edge_rows, prose
from .test_dedup import got_near, slow_components, slow_print, want_exact, want_near

TEXTS = [(1, [prose(1, 40), prose(1, 40), prose(2, 40)]), (2, [prose(2, 40), prose(3, 40)]), (3, [prose(4, 60), prose(4, 60) + " end", ""]), (4, [None, " "])]


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("frames") / "t")
    spark.createDataFrame(TEXTS, "doc_id long, texts array<string>").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def frames(spark, scan):
    rows = scan.select("doc_id", F.explode("texts").alias("text"))
    names = spark.createDataFrame([(1,), (2,), (3,), (4,)], "of_id long")
    return {
        "explode": rows,
        "union": scan.select("doc_id", F.col("texts")[0].alias("text")).union(scan.select("doc_id", F.col("texts")[1])),
        "join": rows.join(names, F.col("doc_id") == F.col("of_id")).select("doc_id", "text"),
        "repartition": rows.repartition(5),
        "self union": scan.select("doc_id", F.col("texts")[0].alias("text")).union(scan.select("doc_id", F.col("texts")[0].alias("text"))),
        "filter": scan.where("doc_id > 1").select("doc_id", F.col("texts")[0].alias("text")),
    }


@pytest.mark.parametrize("name", ["explode", "union", "join", "repartition", "self union", "filter"])
def test_dedup_of_frames(spark, scan, name):
    df = frames(spark, scan)[name]
    rows = [tuple(r) for r in df.collect()]
    keyed = common.with_row_key(df)
    assert keyed.select("file_key", "row_key").distinct().count() == len(rows)
    left = [tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()]
    bare = lambda t: "".join((t or "").split())
    assert len(left) == want_exact(rows)[1] and {bare(t) for _, t in left} == {bare(t) for _, t in rows}
    assert got_near(simhash.near_groups(df)) == want_near(rows)
    # ids repeat here, so components are counted by their fingerprints
    groups = set(slow_components(sorted({slow_print(t) for _, t in rows})).values())
    assert len(simhash.drop_near_copies(df).collect()) == len(groups)


def test_toxic_rows_of_a_generator(spark, scan):
    toxic = "you are a worthless idiot, you scum, and I will kill you"
    df = scan.where("doc_id <= 2").select("doc_id", F.explode(F.array(F.lit("calm words"), F.lit(toxic), F.lit("more calm"))).alias("text"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.drop_toxic(df, none).collect()) == [(1, "calm words"), (1, "more calm"), (2, "calm words"), (2, "more calm")]


def test_neighbours_of_a_generator(spark, scan):
    df = scan.where("doc_id = 1").select(F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))).alias("vec_id")).withColumn("embedding", F.array(F.lit(1.0), F.col("vec_id") + 0.5))
    got = neighbours.nearest(df).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 0), (1, 0), (2, 1), (2, 1)]


def test_only_plain_scans_are_named_by_position(spark, scan):
    assert common._is_scan(scan) and common._is_scan(scan.where("doc_id > 1").select("doc_id")) and common._is_scan(scan.alias("x"))
    for df in [*frames(spark, scan).values()][:5] + [scan.limit(3), scan.withColumn("r", F.rand()), scan.dropDuplicates(["doc_id"]), spark.range(3)]:
        assert not common._is_scan(df)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Held:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, key, default=None: default})()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch(Session())


def test_released_tables_are_gone(spark):
    held = common.cut(spark.range(3))
    path = held._cut_path
    common.release(held, spark.range(2))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_edges(spark, tmp_path, edge_docs, empty_docs, empty):
    # all columns, the clashing ones too, but Text, which a file cannot hold beside text
    common.pick(empty_docs if empty else edge_docs, **{c: c for c in edge_docs.columns if c != "Text"}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").limit(0 if empty else 3).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == names
        if name == "exact_dedup":
            assert docs.count() == want_exact([(r["doc_id"], r["text"]) for r in before.collect()])[1]
        if name == "simhash":
            assert docs.count() == len({(r["root"]) for r in simhash.near_groups(before).collect()})
        if name == "secrets":
            assert docs.count() == before.count() and not docs.where("text like '%AKIAQQQQ%'").count()
    held = defaultdict(list)
    for r in docs.collect():
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] or -1 for r in docs.where("piece = 0").collect()) == sorted(r["doc_id"] or -1 for r in before.collect())
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert empty == (not held) and len(edge_rows()) > 10
