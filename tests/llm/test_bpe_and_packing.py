import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tokenizers

from tesserine.llm import bpe, packing, tokens
from tesserine.llm.queries import QUERIES, TOKENIZER
from tesserine.llm.tokens import LibraryEncoder, encoder

from .conftest import edge_rows


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(TOKENIZER)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoder_matches_the_library_on_random_texts(library):
    own, r = encoder(TOKENIZER), random.Random(5)
    parts = list("abc ABC  \n\t\r\x0b\x1c\x1f\x85\xa0.,!'sdtre0129é漢字ßüकि​　😀") + ["<|endoftext|>", "'s", "'ll", " the", "\n ", " \n", "́", "ſK", "²Ⅷ", "ing", "tion"]
    for _ in range(4000):
        text = "".join(r.choices(parts, k=r.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == packed(ids), text
        assert own.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_pairs_stay_apart_as_merging_says():
    own, r = encoder(TOKENIZER), random.Random(2)
    some = list(own.whole)
    for _ in range(4000):
        a, b = r.choice(some), r.choice(some)
        if b in own.halves and r.random() < 0.5:
            a, b = own.halves[b]
        if a in own.whole and b in own.whole:
            assert own.compatible(a, b) == (own._merged(own.bytes_of[a] + own.bytes_of[b]) == [a, b])


def test_unbroken_text_of_one_word(library):
    text = "a" * 3000 + "zqxj" * 500
    assert encoder(TOKENIZER).encode(text) == packed(library.encode(text, add_special_tokens=False).ids)


def test_bpe_query_on_edges(edge_docs, empty_docs, library):
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(edge_docs, TOKENIZER).collect())
    want = []
    for i, t, *_ in edge_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_decode(empty_docs, TOKENIZER).count() == 0


def test_bpe_query_round_trip(spark, sf, library):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op8_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_packing_ids_are_those_of_the_library(library):
    own, r = LibraryEncoder(TOKENIZER), random.Random(4)
    parts = list("abc ABC  \n\t\r\x0b\x1c\x1f\x85\xa0.,!'sdtre0129é漢字ßüकि​　😀") + ["<|endoftext|>", "'s", " the", "\n ", " \n", "ing", "tion", " word", " token.", "x" * 60]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(6000)]
    texts += [" ".join(r.choices(["alpha", "beta.", "gamma\n", "dé", "9", "<|endoftext|>"], k=r.randint(1, 12))) for _ in range(2000)]
    for at in range(0, len(texts), 256):
        for t, ids in zip(texts[at : at + 256], own.encode(texts[at : at + 256])):
            assert ids == packed(library.encode(t, add_special_tokens=False).ids), t


def test_packing_ids_when_parts_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(tokens, "LIBRARY_WORDS", 7)
    own, r = LibraryEncoder(TOKENIZER), random.Random(5)
    parts = [" foo", " bar.", "\nBaz", "é,", " don't", "|x", " 3.5", "...", "?!", " д", "aд", "\n", " Ñu;", "x" * 60]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(2000)]
    assert own.encode(texts) == [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(own.parts) <= 7 and len(own.old) <= 7


def test_texts_of_a_tokenizer_without_byte_level_are_not_cut():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, texts = tokenizers.Tokenizer.from_file(path), ["Ab cd, ef.\nGh", "two  words", "", "é"]
    plain.no_truncation(), plain.no_padding()
    assert LibraryEncoder(path).encode(texts) == [packed(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def assert_packed(rows, texts, library):
    want = defaultdict(int)
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first, at, k = (len(ids) - 1) % 2048 + 1, 0, 0
        while at < len(ids):
            n = first if k == 0 else 2048
            want[i, k, at, n, zlib.crc32(packed(ids[at : at + n]))] += 1
            at, k = at + n, k + 1
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    return len(places)


def test_packing_on_edges(edge_docs, empty_docs, library):
    for range_rows in (8, packing.RANGE):
        assert_packed(packing.pack(edge_docs, TOKENIZER, range_rows=range_rows).collect(), [r[:2] for r in edge_rows()], library)
    assert packing.pack(empty_docs, TOKENIZER).count() == 0


def test_packing_query_is_close_to_the_least(spark, sf, library):
    rows = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    n = assert_packed(rows, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), library)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 2048)


def serial_superstep(items, gaps, largest):
    """Sizes by item and gaps by sequence to the gap value that each item takes, by one sweep over everything."""
    slots = [(-(g // max(1, g // largest)), False, s, k) for s, g in gaps.items() for k in range(max(1, g // largest))]
    stack, took = [], {}
    for value, is_item, key, _ in sorted(slots + [(-n, True, i, 0) for i, n in items.items()]):
        if not is_item:
            stack.append(-value)
        elif stack:
            took[key] = stack.pop()
    return took


@pytest.mark.parametrize(("seed", "range_rows"), [(0, 7), (1, 25), (2, 1 << 16)])
def test_supersteps_are_one_sweep_however_many_ranges(spark, seed, range_rows):
    r = random.Random(seed)
    items = {i: r.choice([r.randint(1, 100), 50, 20]) for i in range(150)}
    gaps = {s: r.choice([r.randint(1, 100), 100, 60]) for s in range(60)}
    largest = r.choice([max(items.values()), 100])
    df = spark.createDataFrame(list(items.items()), "item long, size long")
    got = packing.superstep(df, spark.createDataFrame(list(gaps.items()), "sequence_id long, gap long"), largest, 210, range_rows).collect()
    assert sorted(x["item"] for x in got) == sorted(items) and all(x["size"] == items[x["item"]] for x in got)
    met = [x for x in got if x["sequence_id"] is not None]
    assert len({(x["sequence_id"], x["slot"]) for x in met}) == len(met) and all(x["gap"] == gaps[x["sequence_id"]] for x in met)
    want = serial_superstep(items, gaps, largest)
    assert {x["item"]: x["gap"] // max(1, x["gap"] // largest) for x in met} == want


def test_ranges_left_over_match_by_rank():
    # parts from the largest sizes down: (part, items, gaps) left over
    assert packing.across([(0, 0, 3), (1, 2, 1), (2, 4, 0), (3, 0, 2)]) == [(1, 0, 2, 0, 0), (2, 0, 1, 1, 0), (2, 1, 1, 0, 1)]


@pytest.mark.parametrize(("seed", "range_rows"), [(0, 9), (1, 1 << 16)])
def test_best_fit_places_every_item_once(spark, seed, range_rows):
    r = random.Random(seed)
    items = [(i, r.choice([r.randint(1, 100), r.randint(1, 20), 100, 34])) for i in range(200)]
    got = packing.best_fit(spark.createDataFrame(items, "item long, size long"), 100, range_rows).collect()
    sizes, used = dict(items), defaultdict(list)
    assert sorted(x["item"] for x in got) == sorted(sizes)
    for x in got:
        used[x["sequence_id"]].append((x["offset"], sizes[x["item"]]))
    for held in used.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 100
    # as one item at a time, largest first, into the fullest that has room; a few sequences more at most
    gaps = []
    for n in sorted(sizes.values(), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        gaps.append(100 - n) if fit is None else gaps.__setitem__(gaps.index(fit), fit - n)
    assert len(used) <= 1.03 * len(gaps) + 1
