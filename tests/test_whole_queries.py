"""Registered queries on small tables whose rows need the whole job, against slow versions."""

import contextlib
import html
import json
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tesserine.operators import export, index
from tesserine.plans.queries import QUERIES, SQL

from .test_text import slow_prose

WORDS = " ".join(f"word{k}" for k in range(110))


def slow_clean(t):
    t = re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<ref\b[^>]*>.*?</ref>", " ", html.unescape(t)))
    t = re.sub("[ \t]+", " ", re.sub(r"\s*\n\s*\n\s*", "\n", t))
    return "\n".join(x.strip() for x in t.splitlines()).strip()


def documents(spark, path, texts):
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_clean_queries_decode_every_entity(spark, tmp_path):
    pages = ["<p>caf&eacute; &#233; &#xe9; &amp b &ampc &bogus; &lt;br&gt; &amp;amp;</p>", "a &mdash; b\n\n c &hellip;", "plain", "&copy 2020 &notin; &#128;", ""]
    spark.createDataFrame([(k, "u", t) for k, t in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in QUERIES["clean_html"](spark, str(tmp_path)).collect()}
    assert got == {k: slow_clean(t) for k, t in enumerate(pages)}
    sf = documents(spark, tmp_path, [f"caf&eacute; &#233; &mdash; {WORDS} &amp x"])
    assert [r["content"] for r in QUERIES["clean_articles"](spark, sf).collect()] == [f"café é — {WORDS} & x"]


SPANS = f"{WORDS} [[File:a.jpg|thumb|a [[deep|view]]]] more {{{{cite|{{{{inner}}}} x}}}} end [[b|c]]"


def test_queries_remove_spans_inside_prose(spark, tmp_path):
    sf = documents(spark, tmp_path, [SPANS] * 10)
    marked = {k: t for k, t in QUERIES["remove_nested"](spark, sf).collect()}
    assert len(marked) == 10 and all("thumb" not in t and "cite" not in t for t in marked.values())
    got = dict(QUERIES["strip_markup_whole"](spark, sf).collect())
    assert got == {k: slow_prose(t) for k, t in marked.items()}
    assert [r["content"] for r in QUERIES["clean_articles"](spark, sf).collect()] == [slow_prose(SPANS)] * 10
    items = {r["idx"]: json.loads(r["item"])["Item"] for r in QUERIES["kv_export_whole"](spark, sf).collect()}
    # 0, 1, 2, 6 and 9 are furniture
    assert {k: x["text"]["S"] for k, x in items.items()} == {k: got[k] for k in (3, 4, 5, 7, 8)}
    (n,) = QUERIES["kv_export_counters_whole"](spark, sf).collect()
    assert (n["n_read"], n["n_written"], n["n_dropped"]) == (10, 5, 5)


def test_export_joins_every_curid(spark, tmp_path):
    sf = documents(spark, tmp_path, [WORDS] * 100)
    items = [json.loads(r["item"])["Item"] for r in QUERIES["kv_export_whole"](spark, sf).collect()]
    last = {}
    for k in range(100):
        last[f"doc-s{k % 2}-{k % 50}"] = k
    assert len(items) == 50 and any(k % 7 == 0 for k in last.values())
    assert all(x["curid"]["N"] == str(last[x["title"]["S"]]) for x in items)
    (n,) = QUERIES["kv_export_counters_whole"](spark, sf).collect()
    assert n["n_missing_curid"] == 0
    rows = spark.createDataFrame([(0, "A", "kept"), (1, "B", "kept")], "idx long, article_title string, text string")
    some = export.key_values(rows, spark.createDataFrame([("A", 7)], "title string, curid long"))
    assert "curid" not in json.loads(dict(export.items(some).collect())[1])["Item"]
    assert export.counters(some).first()["n_missing_curid"] == 1


@contextlib.contextmanager
def many_partitions(spark):
    """Shuffles that stay apart, as those of larger tables do: on small ones all rows meet in one partition anyway."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def by_sql(path, name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return sorted(c.execute(SQL[name]).fetchall())


def test_text_search_meets_every_block(spark, tmp_path):
    # three blocks of documents, one row in 100 without a text
    texts = [None if k % 100 == 7 else f"word{k % 83} w{k % 41} v{k * k % 59} u{k % 7}" for k in range(9000)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(k, f"word{k} v{k} u{k % 7}") for k in range(20)] + [(20, None), (21, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with many_partitions(spark):
        found = QUERIES["text_search_hashed"](spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()
    want = by_sql(tmp_path, "text_search_hashed", "documents", "benchmark")
    assert len(want) == 100 and [tuple(r) for r in sorted(found)] == want


def test_block_search_meets_every_block(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(9000, 4)).round(2).astype(np.float32)  # three blocks
    x[5000:5100] = x[100]  # copies around the last place
    spark.createDataFrame([(k, k % 5, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with many_partitions(spark):
        found = QUERIES["knn_blocks"](spark, str(tmp_path)).collect()
    want = by_sql(tmp_path, "knn_blocks", "embeddings")
    assert len(want) == 90 * 50 and [tuple(r) for r in sorted(found)] == want


def test_block_search_is_not_misled_by_rounding(spark):
    # far from the origin, the products lose the digits that tell the neighbours apart
    x = 1e5 + np.random.default_rng(4).normal(size=(600, 8)).round(3) / 1e3
    x[300:400] = x[0]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "idx long, embedding array<double>")
    asked = rows.where("idx < 5").select(F.col("idx").alias("qid"), F.col("embedding").alias("vec"))
    found = {(r["qid"], r["rank_pos"]): (r["idx"], r["distance"]) for r in index.search_blocks(rows, asked, 20, block=200).collect()}
    assert found == {(r["qid"], r["rank_pos"]): (r["idx"], r["distance"]) for r in index.search_flat(rows, asked, 20).collect()}
    assert [found[0, k][0] for k in range(20)] == [0, *range(300, 319)]
