import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine import cli
from tesserine.config import Mining, Rerank, Settings
from tesserine.operators import contain, encode, export, index, linkgraph, metrics, mining, passages, search, storage
from tesserine.plans import build
from tesserine.sources import readers
from tesserine.streaming import incremental

INSERTS = r"""-- dump
INSERT INTO `page` VALUES (1,0,'A_page',0),(2,0,'It\'s_two',0),(3,1,'Rock,_\'n\',_Roll',0);
INSERT INTO `other` VALUES (9);
""", "INSERT INTO `pagelinks` VALUES (1,0,10),(1,0,11),(2,0,10),(3,1,10),(1,0,10);\n", r"INSERT INTO `linktarget` VALUES (10,0,'Target'),(11,4,'It\'s_two'),(12,0,'Red_link');" + "\n"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def dumps(tmp_path):
    for name, content in zip(("page", "pagelinks"), INSERTS):
        (tmp_path / f"{name}.sql").write_text(content)
    with gzip.open(tmp_path / "linktarget.sql.gz", "wt") as f:
        f.write(INSERTS[2])
    return str(tmp_path)


def test_dump_parsers(spark, dumps):
    page = readers.insert_lines(spark, f"{dumps}/page.sql")
    assert rows_of(readers.parse_pages(page), "page_id", "title") == [(1, "A page"), (2, "It's two"), (3, "Rock, 'n\\")]
    assert (3, "Rock, 'n', Roll") in rows_of(readers.parse_pages(page, whole_titles=True), "page_id", "title")
    assert rows_of(readers.parse_page_links(readers.insert_lines(spark, f"{dumps}/pagelinks.sql")), "from_id", "to_id") == [(1, 10), (1, 10), (1, 11), (2, 10)]
    assert rows_of(readers.parse_link_targets(readers.insert_lines(spark, f"{dumps}/linktarget.sql.gz")), "lt_id", "lt_title") == [(10, "Target"), (11, "It's two"), (12, "Red link")]


def test_link_graph(spark):
    edge = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("A", "C"), ("C", "B")], "from_title string, to_title string")
    lists = linkgraph.adjacency(edge)
    assert rows_of(lists, "from_title", "linked_titles") == [("A", ["B", "C", "C"]), ("B", ["C"]), ("C", ["B"])]
    counts = linkgraph.backlink_counts(edge)
    assert rows_of(counts, "title", "count") == rows_of(linkgraph.backlink_counts_of_lists(lists), "title", "count") == [("B", 2), ("C", 3)]
    asked = spark.createDataFrame([("A",), ("Z",)], "title string")
    assert rows_of(linkgraph.outlinks(asked, lists), "title", "linked_titles") == [("A", ["B", "C"]), ("Z", [])]
    assert rows_of(linkgraph.with_counts(asked.union(spark.createDataFrame([("C",)], "title string")), counts), "title", "backlinks") == [("A", 0), ("C", 3), ("Z", 0)]
    once, skipped = linkgraph.unique_adjacency(lists.union(lists))
    assert once.count() == 3 and skipped.first()["skipped"] == 3


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 250])
def test_top_percentile_is_the_offset_query(spark, n):
    values = [(k * 7919) % 83 for k in range(n)]
    got = linkgraph.top_percentile(spark.createDataFrame([(str(k), v) for k, v in enumerate(values)], "title string, count long")).first()[0]
    assert got == (sorted(values, reverse=True)[int(n * 0.01)] if n else 1)


def test_fragments(spark, tmp_path):
    body = "\n\n".join(["Some Title", "short", "[[File:x.jpg|a caption that is much longer than seventy characters, which is what counts here]]"] + ["word " * 30 + f"line {k} [[link|shown]]" for k in range(4)])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a").write_text(f'<doc id="1" url="u?curid=1" title="Some Title">\n{body}\n</doc>\n<doc id="2" url="u2" title="Few">too few words <b>x</b> tail</doc>\n')
    (tmp_path / "bad").write_text('<doc id="3" url="u" title="T">a & b < c</doc>')
    strict = readers.read_fragments(spark, str(tmp_path))
    assert rows_of(strict, "id", "title") == [("1", "Some Title"), ("2", "Few")]
    assert [r["raw"] for r in strict.collect() if r["id"] == "2"] == ["too few words"]
    assert len(readers.broken_files(spark, str(tmp_path)).collect()) == 1
    assert rows_of(readers.read_fragments(spark, str(tmp_path), strict=False), "id") == [("1",), ("2",), ("3",)]
    for nested in (True, False):
        (one,) = readers.articles(strict, nested=nested).collect()
        assert one["content"].split("\n\n") == [("word " * 30 + f"line {k} shown").strip() for k in range(4)]
    edge = "a" * 69
    for text, kept in ((" ".join(["w" * 10] * 100), True), (" ".join(["w" * 10] * 99), False), (f"{' '.join(['w' * 10] * 99)}\n{edge}", False), (f"{' '.join(['w' * 10] * 99)}\n{edge}a", True)):
        assert (readers.articles(spark.createDataFrame([("1", "u", "t", text)], "id string, url string, title string, raw string")).count() == 1) == kept


def test_json_sources(spark, tmp_path):
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "x.json").write_text(json.dumps([{"id": "1", "url": "u", "title": "t", "content": "é"}, {"id": "2"}], ensure_ascii=False))
    assert rows_of(readers.read_articles(spark, str(tmp_path / "array")).fillna(""), "id", "content") == [("1", "é"), ("2", "")]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.jsonl").write_text('{"id": "1", "title": "t"}\nnot json\n{"id": "2"}\n')
    good, broken = readers.read_article_lines(spark, str(tmp_path / "lines"))
    assert good.count() == 2 and [r[0] for r in broken.collect()] == ["not json"]
    (tmp_path / "q.json").write_text(json.dumps([{"query": "a", "relevant_articles": ["X", "Y"]}, {"query": "b", "relevant_articles": []}]))
    assert rows_of(readers.read_test_queries(spark, str(tmp_path / "q.json")), "qid", "query", "relevant_articles") == [(0, "a", ["X", "Y"]), (1, "b", [])]


def test_triplet_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"t{k}.jsonl").write_text(json.dumps({"anchor": f"a{k}", "positive": "p", "negative": "n", "source": "s", "url": ""}) + "\n")
    train, held = readers.read_triplets(spark, str(tmp_path / "*.jsonl"), 3)
    assert rows_of(train, "anchor") == [("a3",)] and rows_of(held, "anchor") == [("a0",), ("a1",), ("a2",)]
    train, held = readers.read_triplets(spark, str(tmp_path / "t0.jsonl"), 3, seed=1)
    assert train.count() == 1 and held.count() == 0 and train.columns == ["anchor", "positive", "negative"]


@pytest.mark.parametrize(("rows", "want"), [(500, (100, 500)), (10**6, (4000, 160_000)), (41_953_396, (25_908, 1_036_320)), (10**9, (65_536, 2_621_440))])
def test_ivf_parameters(spark, rows, want):
    assert index.ivf_parameters(rows) == want


def test_index_rules():
    assert index.index_type("auto", 1000, 384) == "flat" and index.index_type("auto", 41_953_396, 384) == "ivfpq" and index.index_type("flat", 10**9, 384) == "flat"
    with pytest.raises(ValueError):
        index.index_type("hnsw", 1, 1)
    with pytest.raises(ValueError):
        index.check_flat(41_953_396, 384)
    with pytest.raises(ValueError):
        index.check_parts(10, 3)


def vectors(spark, n=400, dim=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "idx long, embedding array<float>").repartition(3)


def test_flat_and_block_search_agree(spark):
    x, rows = vectors(spark)
    asked = rows.where("idx < 7").select(F.col("idx").alias("qid"), F.col("embedding").alias("vec"))
    near = lambda df: {(r["qid"], r["rank_pos"]): r["idx"] for r in df.collect()}
    want = {(q, k): int(i) for q in range(7) for k, i in enumerate(np.argsort(((x.astype(float) - x[q].astype(float)) ** 2).sum(1), kind="stable")[:20])}
    assert near(index.search_flat(rows, asked, 20)) == near(index.search_blocks(rows, asked, 20, block=64, asked=3)) == want


def test_top_k_is_pruned_before_the_shuffle(spark):
    _, rows = vectors(spark, 20)
    asked = rows.where("idx < 3").select(F.col("idx").alias("qid"), F.col("embedding").alias("vec"))
    plan = index.search_flat(rows, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_lists_and_codes(spark):
    x, rows = vectors(spark)
    asked = rows.where("idx < 20").select(F.col("idx").alias("qid"), F.col("embedding").alias("vec"))
    flat = {(r["qid"], r["idx"]) for r in index.search_flat(rows, asked, 10).collect()}
    centroids = index.train_lists(rows, 8).cache()
    listed = index.assign_lists(rows, centroids)
    recall = lambda df: len(flat & {(r["qid"], r["idx"]) for r in df.collect()}) / len(flat)
    assert recall(index.search_lists(listed, centroids, asked, 10, nprobe=8)) == 1.0
    assert recall(index.search_lists(listed, centroids, asked, 10, nprobe=3)) > 0.6
    book = index.train_codebook(rows, 8, parts=4, codes=32).cache()
    coded = index.pq_encode(rows, book, 8, 4)
    assert recall(index.search_codes(coded, book, asked, 10, 8, 4)) > 0.5
    back = {r["idx"]: r["decoded"] for r in index.pq_decode(coded, book).collect()}
    error = np.mean([((np.array(back[k]) - x[k]) ** 2).sum() for k in range(400)])
    assert error < 0.35 * (x**2).sum(1).mean()
    index.assert_aligned(coded, rows)
    with pytest.raises(index.MisalignedIndex):
        index.assert_aligned(coded.where("idx <> 3"), rows)
    with pytest.raises(index.MisalignedIndex):
        index.assert_aligned(coded.union(coded.where("idx = 3")), rows)


def small_store(spark):
    rows = [(0, "A", "text a", [1.0, 0.0, 0.0, 0.0], 7), (1, "B", "text b", [0.6, 0.8, 0.0, 0.0], None), (2, "A", "text a2", [0.8, 0.6, 0.0, 0.0], 7), (3, "", "no title", [1.0, 0.0, 0.0, 0.0], None), (4, "Z", "zero", [0.0] * 4, None)]
    return spark.createDataFrame(rows, "idx long, title string, text string, embedding array<float>, curid long")


def found(spark, queries, **more):
    store = small_store(spark)
    asked = spark.createDataFrame(queries, "qid long, query string, vec array<float>")
    candidates = index.search_flat(store, asked, search.pool_size(5))
    return search.search(store, candidates, asked, **more).orderBy("qid", "rank").collect()


def test_search_keeps_the_best_passage_of_each_article(spark):
    got = found(spark, [(0, "q", [2.0, 0.0, 0.0, 0.0])], urls=spark.createDataFrame([("B", "http://b")], "title string, url string"))
    assert [(r["title"], r["snippet"], r["url"], round(r["score"], 6), r["reranked"]) for r in got] == [("A", "text a", "https://en.wikipedia.org/wiki?curid=7", 1.0, False), ("B", "text b", "http://b", 0.6, False), ("Z", "zero", "", 0.0, False)]
    assert len(found(spark, [(0, "q", [1.0, 0.0, 0.0, 0.0])], k=1)) == 1
    assert all(r["score"] == 0 for r in found(spark, [(0, "q", [0.0] * 4)]))


def test_rerank(spark):
    counts = spark.createDataFrame([("B", 540), ("A", 5)], "title string, count long")
    got = found(spark, [(0, "the b B", [1.0, 0.0, 0.0, 0.0])], counts=counts)
    score = {r["title"]: r["score"] for r in got}
    assert math.isclose(score["B"], 0.6 + 0.5 / 2 + 0.3, rel_tol=1e-6) and math.isclose(score["A"], 1 + 0.3 * math.log(6) / math.log(541), rel_tol=1e-6)
    assert [r["title"] for r in got] == ["B", "A", "Z"] and all(r["reranked"] for r in got) and round(got[0]["cosine"], 6) == 0.6
    over = found(spark, [(0, "", [1.0, 0.0, 0.0, 0.0])], counts=counts, settings=Rerank(max_backlinks=5))
    assert math.isclose({r["title"]: r["score"] for r in over}["A"], 1.3, rel_tol=1e-6) and {r["title"]: r["score"] for r in over}["B"] > 0.9
    own = found(spark, [(0, "", [1.0, 0.0, 0.0, 0.0])], counts=counts, settings=Rerank(max_backlinks=0))
    assert math.isclose({r["title"]: r["score"] for r in own}["B"], 0.9, rel_tol=1e-6)


def test_metrics_by_hand(spark):
    queries = spark.createDataFrame([(0, ["B", "c"]), (1, ["X"]), (2, [])], "qid long, relevant_articles array<string>")
    ranking = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "C"), (1, 1, "x"), (1, 2, "x")], "qid long, rank int, title string")
    value = {r["metric"]: r["value"] for r in metrics.evaluate(queries, ranking, metrics.relevant_titles(queries)).collect()}
    third = lambda x: round(x / 3, 4)
    # titles that come twice are hits twice for MAP, and once within R
    assert value == {"MRR": third(1.5), "R-Precision": third(1.5), "MAP": third((1 / 2 + 2 / 3) / 2 + 2), "Top-1 Accuracy": third(1), "Top-3 Accuracy": third(2), "Top-5 Accuracy": third(2), "Top-10 Accuracy": third(2)}
    two = queries.where("qid < 2")
    plain = ranking.where("not (qid = 1 and rank = 2)")
    value = {r["metric"]: r["value"] for r in metrics.evaluate(two, plain, metrics.relevant_titles(two)).collect()}
    assert (value["MRR"], value["MAP"], value["R-Precision"], value["Top-1 Accuracy"], value["Top-3 Accuracy"]) == (0.75, 0.7917, 0.75, 0.5, 1.0)
    at = {r["metric"]: r["value"] for r in metrics.at_k(two, plain, metrics.relevant_titles(two), 10).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert math.isclose(at["ndcg@10"], ((1 / math.log2(3) + 1 / 2) / ideal + 1) / 2, abs_tol=1e-6) and at["recall@10"] == 1.0 and at["precision@10"] == 0.15


def test_evaluation_corpus(spark):
    rows = spark.createDataFrame([(k, f"t{k % 4}", f"text {k}") for k in range(200)], "idx long, article_title string, text string")
    queries = spark.createDataFrame([(0, "q", ["t0", "gone"]), (1, "r", ["gone"])], "qid long, query string, relevant_articles array<string>")
    corpus = metrics.evaluation_corpus(rows, queries, distractors=30).cache()
    assert corpus.where("relevant").count() == 20 and corpus.where("not relevant").count() == 30 and corpus.select("idx").distinct().count() == 50
    assert rows_of(metrics.answerable(queries, rows), "qid") == [(0,)]
    assert metrics.relevant_passages(queries, corpus, rows).count() == 20


def test_dense_ids_and_lookup(spark):
    rows = spark.createDataFrame([(f"a{k % 7}", k // 7, f"t{k}") for k in range(70)], "id string, pos int, text string").repartition(5)
    placed = passages.dense_ids(rows, ["id", "pos"], partitions=4)
    assert [r["idx"] for r in placed.orderBy("id", "pos").collect()] == list(range(70))
    assert passages.dense_ids(rows.limit(0), ["id", "pos"]).count() == 0
    ids = spark.createDataFrame([(3,), (3,), (-1,), (900,), (69,)], "idx long")
    assert rows_of(passages.lookup(placed, ids), "idx") == [(3,), (69,)]
    assert rows_of(passages.batch_manifest(placed, 32), "seq", "first_idx", "row_count") == [(0, 0, 32), (1, 32, 32), (2, 64, 6)]


def test_encoders(spark):
    rows = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None)], "k int, text string")
    got = {r["k"]: r["v"] for r in rows.select("k", encode.hashed_words(F.coalesce("text", F.lit("")), 16).alias("v")).collect()}
    assert math.isclose(sum(x * x for x in got[0]), 1) and sorted(x for x in got[0] if x) == [1 / math.sqrt(5), 2 / math.sqrt(5)] and got[1] == [0.0] * 16
    model = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    made = {r["k"]: r["embedding"] for r in encode.encode(rows, model, rows=2).collect()}
    assert np.allclose(made[0], np.array([5, 1]) / math.sqrt(26)) and made[2] == [0.0, 1.0]


def test_mining(spark):
    settings = Mining(rank_min=1, rank_max=4, pool=3, min_paragraph_chars=3)
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    articles = spark.createDataFrame([("A", "\n\n".join([long] * 12)), ("B", long + "\n\nshort"), ("", "\n\n".join([long] * 3)), ("C", None)], "title string, content string")
    good = mining.mining_articles(articles)
    assert rows_of(good, "title") == [("A",)]
    assert mining.anchors(good).count() == 10 and mining.anchors(good).first()["anchor"] == "A"
    assert mining.anchors(good, Mining(sentence_anchor_probability=1.0)).first()["anchor"].startswith("one two")
    near = spark.createDataFrame([(0, k, k) for k in range(6)], "qid long, idx long, rank_pos int")
    band = mining.negative_band(near, settings)
    assert rows_of(band, "idx") == [(1,), (2,), (3,)]
    store = spark.createDataFrame([(1, "A", "own article"), (2, "L", "linked article"), (3, "N", "negative")], "idx long, title string, text string")
    own = spark.createDataFrame([(7, 0, "A", "A", "positive text")], "key long, qid long, title string, anchor string, positive string")
    links = spark.createDataFrame([("A", "L")], "from_title string, to_title string")
    (one,) = mining.triplets(own, band, store, links, settings=settings).collect()
    assert (one["negative"], one["source"], one["url"]) == ("negative", "A", "")
    assert mining.triplets(own, band, store, links.union(spark.createDataFrame([("A", "N")], links.schema)), settings=settings).count() == 0
    again = own.withColumn("positive", F.lit("negative"))
    assert mining.triplets(again, band, store, links, settings=settings).count() == 0


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(0, "A", "plain [[x|é]] text"), (1, "B", "| table"), (2, "C", "kept")], "idx long, article_title string, text string")
    titles = spark.createDataFrame([("A", "http://x?curid=5"), ("C", "http://x")], "title string, url string")
    made = export.key_values(rows, export.curids(titles)).cache()
    assert rows_of(export.items(made), "idx", "item") == [(0, '{"Item":{"idx":{"N":"0"},"text":{"S":"plain é text"},"title":{"S":"A"},"curid":{"N":"5"}}}'), (2, '{"Item":{"idx":{"N":"2"},"text":{"S":"kept"},"title":{"S":"C"}}}')]
    assert export.counters(made).first().asDict() == {"n_read": 3, "n_written": 2, "n_dropped": 1, "n_cleaned": 1, "n_missing_curid": 1}
    export.write_items(made, str(tmp_path / "kv"), rows_per_file=1)
    assert len(list((tmp_path / "kv").glob("*.gz"))) == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        export.write_items(made, str(tmp_path / "kv"))
    twice = spark.createDataFrame([("A", "u1", 1), ("A", "u2", 2), ("", "u3", 3)], "title string, url string, at int")
    assert rows_of(export.article_titles(twice, F.col("at")), "title", "url") == [("A", "u2")]


def test_codes_within_probed_lists(spark, tmp_path):
    x, rows = vectors(spark)
    asked = rows.where("idx < 20").select(F.col("idx").alias("qid"), F.col("embedding").alias("vec"))
    centroids, book = index.train_lists(rows, 8), index.train_codebook(rows, 8, parts=4, codes=32)
    coded = index.pq_encode(index.assign_lists(rows, centroids), book, 8, 4).select("list_id", "idx", "codes")
    storage.save(coded, str(tmp_path / "i"), by=["list_id"])
    stored = storage.open_table(spark, str(tmp_path / "i"))
    # every list probed: as all codes
    near = lambda df: {(r["qid"], r["rank_pos"]): round(r["distance"], 9) for r in df.collect()}
    assert near(index.search_ivfpq(stored, centroids, book, asked, 10, 8, 4, nprobe=8)) == near(index.search_codes(coded, book, asked, 10, 8, 4))
    one = asked.where("qid = 3")
    found = index.search_ivfpq(stored, centroids, book, one, 10, 8, 4, nprobe=2)
    lists = sorted(r["list_id"] for r in index.probe_lists(one, centroids, 2).collect())
    want = rows_of(index.search_codes(coded.where(F.col("list_id").isin(lists)), book, one, 10, 8, 4), "rank_pos", "idx")
    assert rows_of(found, "rank_pos", "idx") == want
    # only these folders are read, and no vector
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(str(k) in plan[plan.index("PartitionFilters") :].split("]")[0] for k in lists) and "embedding" not in plan[plan.index("FileScan parquet [idx") :].split("\n")[0]
    assert index.search_ivfpq(stored, centroids, book, asked.limit(0), 10, 8, 4).count() == 0


def test_nearest_lists_break_ties_by_number(spark):
    centres = spark.createDataFrame([(2, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (3, [5.0, 5.0])], "list_id int, centroid array<double>")
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [9.0, 9.0])], "idx long, embedding array<float>")
    assert rows_of(index.assign_lists(rows, centres), "idx", "list_id") == [(0, 1), (1, 0), (2, 3)]
    asked = rows.select(F.col("idx").alias("qid"), F.col("embedding").alias("vec"))
    assert rows_of(index.probe_lists(asked, centres, 2), "qid", "list_id") == [(0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 3)]
    assert index.probe_lists(asked, centres, 9).count() == 12


def test_texts_that_contain_items(spark):
    texts = ["the quick brown fox jumps over the lazy dog today", "quick brown fox", None, "", "thequick brown fox jumps overthe", "the  quick brown fox jumps over"]
    items = ["the quick brown fox jumps over", "quick brown fox jumps over", "brown", "he quick brown fox jum", "no such words in here at all", "fox jumps over the lazy", "o"]
    a = spark.createDataFrame(list(enumerate(texts)), "key long, body string")
    b = spark.createDataFrame(list(enumerate(items)), "item long, part string")
    want = sorted((k, i) for k, t in enumerate(texts) for i, x in enumerate(items) if t and x in t)
    assert rows_of(contain.containing(a, b), "key", "item") == want
    long = b.where("item in (0, 1, 3, 4, 5)")
    got = contain.containing(a, long)
    assert rows_of(got, "key", "item") == [x for x in want if x[1] in (0, 1, 3, 4, 5)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    few, wide = spark.range(3), spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(storage.broadcast_if_small(few)) and not hinted(storage.broadcast_if_small(few, 2))
    assert hinted(storage.broadcast_if_small(wide)) and not hinted(storage.broadcast_if_small(wide, most_bytes=1000))


def test_json_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), "u", f"té{k}", 'a "quoted"\nline') for k in range(5)], "id string, url string, title string, content string")
    export.write_json_arrays(rows.repartition(2), str(tmp_path / "a"))
    held = [json.loads(p.read_text()) for p in (tmp_path / "a").glob("part-*")]
    assert sorted(x["title"] for xs in held for x in xs) == [f"té{k}" for k in range(5)] and readers.read_articles(spark, str(tmp_path / "a")).count() == 5
    export.write_json_arrays(rows.limit(0), str(tmp_path / "none"))
    assert readers.read_articles(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, content in {"x.json": '[{"id": "1"}, {"id": "2", "n": [1, 2]}, null]', "sub/y.json": "[]", "sub/z.json": '[{"id": "3"}]', "obj.json": '{"id": "4"}', "bad.json": "[{]", "worse.json": "nothing"}.items():
        (tmp_path / "in" / name).write_text(content)
    told = export.arrays_to_lines(spark, str(tmp_path / "in"), str(tmp_path / "out")).first().asDict()
    assert told == {"n_files": 6, "n_skipped": 1, "n_broken": 2, "n_lines": 3}
    lines = spark.read.text(str(tmp_path / "out"))
    assert sorted((r["file"], json.loads(r["value"])["id"]) for r in lines.collect()) == [("sub/z.json", "3"), ("x.json", "1"), ("x.json", "2")]


def test_triplet_files_through_the_reader_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", "n", "s", "")], "anchor string, positive string, negative string, source string, url string")
    export.write_json_lines(rows, str(tmp_path / "t"))
    train, held = readers.read_triplets(spark, str(tmp_path / "t"))
    assert rows_of(train.union(held), "anchor", "positive", "negative") == [("a", "p", "n")]


def test_storage(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        storage.open_table(spark, str(tmp_path / "none"))
    storage.save(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        storage.save(spark.range(3), str(tmp_path / "t"))
    storage.save(spark.range(4), str(tmp_path / "t"), overwrite=True)
    assert storage.open_table(spark, str(tmp_path / "t")).count() == 4


def test_incremental_passages(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    line = lambda k: json.dumps({"id": str(k), "url": "u", "title": f"t{k}", "content": "a\n\nb"}) + "\n"
    (source / "0.jsonl").write_text(line(0) + "broken\n")
    run = lambda: incremental.passage_batches(incremental.article_stream(spark, str(source)), out, mark, build.hashed).awaitTermination()
    run()
    (source / "1.jsonl").write_text(line(1))
    run()
    run()
    assert rows_of(spark.read.parquet(out), "idx", "article_title", "pos", "text") == [(0, "t0", 0, "a"), (1, "t0", 1, "b"), (2, "t1", 0, "a"), (3, "t1", 1, "b")]
    assert rows_of(spark.read.parquet(f"{out}-counts"), "n_lines", "n_broken", "n_passages") == [(1, 0, 2), (2, 1, 2)]


def test_backlinks_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    seen = [("B", "2024-01-01T10:00:00"), ("C", "2024-01-01T11:00:00"), ("B", "2024-01-01T12:00:00"), ("B", "2024-01-03T00:00:00")]
    (source / "0.json").write_text("".join(json.dumps({"to_title": t, "seen": s}) + "\n" for t, s in seen))
    (source / "1.json").write_text(json.dumps({"to_title": "C", "seen": "2023-12-01T00:00:00"}) + "\n")
    stream = spark.readStream.schema("to_title string, seen timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(source))
    run = incremental.backlink_stream(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(r["count"] for r in spark.table("counted").where("title = 'B'").collect()) == 3


def test_whole_build_and_command_line(spark, dumps, tmp_path, capsys, monkeypatch):
    raw, out = tmp_path / "raw", str(tmp_path / "built")
    raw.mkdir()
    line = lambda w: " ".join(f"{w}{k}" for k in range(40))
    docs = [(1, "A page", "apple"), (2, "It's two", "pear"), (3, "Target", "plum")]
    (raw / "x").write_text("".join(f'<doc id="{i}" url="http://x?curid={i}" title="{t}">\n' + "\n\n".join(line(w + x) for x in "abcd") + "\n</doc>\n" for i, t, w in docs))
    with pytest.raises(ValueError):
        build.run(spark, str(raw), dumps, out, "nothing")
    settings = Settings(mining=Mining(rank_min=0, rank_max=12))
    build.run(spark, str(raw), dumps, out, with_triplets=True, settings=settings)
    engine = build.Engine(spark, out)
    assert engine.health() == {"vectors": 12, "index": "flat", "rerank": True}
    asked = spark.createDataFrame([(0, line("pearb"), ["It's two"])], "qid long, query string, relevant_articles array<string>")
    first = engine.search(asked.select("qid", "query"), 2).orderBy("rank").first()
    assert first["title"] == "It's two" and first["url"] == "http://x?curid=2" and first["reranked"]
    assert not engine.search(asked.select("qid", "query"), 2, rerank=False).first()["reranked"]
    assert {r["metric"]: r["value"] for r in engine.evaluate(asked).collect()}["MRR"] == 1.0
    mined = spark.read.json(f"{out}/triplets").collect()
    assert mined and all(r["source"] != "Target" and r["positive"] != r["negative"] for r in mined)
    build.build_index(spark, out, "ivfpq", parts=8, bits=2)
    assert build.Engine(spark, out).health()["index"] == "ivfpq"
    assert build.Engine(spark, out).search(asked.select("qid", "query"), 2).count() >= 1
    build.mine(spark, out, f"{out}/mined", settings)
    again = spark.read.json(f"{out}/mined").collect()
    assert again and all(r["source"] != "Target" and r["positive"] != r["negative"] for r in again)
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["search", out, line("pluma"), "-k", "1"]) == 0 and "Target" in capsys.readouterr().out
    (tmp_path / "q.json").write_text(json.dumps([{"query": line("applec"), "relevant_articles": ["a PAGE"]}]))
    assert cli.main(["evaluate", out, str(tmp_path / "q.json")]) == 0 and "MRR: 1.0" in capsys.readouterr().out
    assert cli.main(["inspect-index", out]) == 0
