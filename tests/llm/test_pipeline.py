from collections import defaultdict

import corpus_pipeline
from tesserine.llm import simhash, toxicity
from tesserine.llm.queries import TOKENIZER

from .test_dedup import slow_components, slow_print, want_exact
from .test_models import slow_spans


def test_each_stage_on_its_own_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        held[name] = (docs, spark.read.parquet(f"{tmp_path}/{k}"))
        docs = held[name][1]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names

    before, after = held["toxicity"]
    scores = toxicity.toxicity(before, toxicity.taught(before, spark.read.parquet(f"{sf}/labels.parquet")))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scores.where("predicted = 0").collect()}

    before, after = held["exact_dedup"]
    assert after.count() == want_exact([(r["doc_id"], r["text"]) for r in before.collect()])[1]

    before, after = held["simhash"]
    prints = {r["doc_id"]: slow_print(r["text"]) for r in before.collect()}
    comp = slow_components(sorted(set(prints.values())))
    groups = defaultdict(list)
    for i, p in prints.items():
        groups[comp[p]].append(i)
    assert {r["doc_id"] for r in after.collect()} == {min(g) for g in groups.values()}

    before, after = held["secrets"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        spans = slow_spans(texts[r["doc_id"]])
        assert (r["text"] == texts[r["doc_id"]]) == (not spans) and not slow_spans(r["text"]) and r["n_chars"] == len(r["text"])

    before, after = held["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    assert after.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run_gives_pieces_of_what_is_kept(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < got.select("doc_id").distinct().count() < 1000
