import html
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from tesserine.llm import language, neighbours, quality, secrets, toxicity
from tesserine.llm.common import pick
from tesserine.llm.labelled import teaching_texts
from tesserine.llm.queries import QUERIES

from .conftest import edge_rows

BASE = [
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def slow_spans(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(x for *_, x in sorted(found))


def base_of(spans):
    return ",".join(x for x in spans.split(",") if x.split(":")[0] in ("assign", "access", "hex"))


def test_secrets_on_edges(spark, edge_docs, empty_docs):
    tricky = ["token=token:abcdefgh", "TOKEN = 'x.y-z/1+2='", "api_key:abcdef apikey=\"12345", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "9" * 14, "f" * 23, "f" * 24 + "F" + "0" * 30, "é" * 5 + "password=abcdef\npasswd: 'ghijkl'", "ghp_" + "a" * 36, "secret" * 3 + "=abcdef"]
    docs = pick(edge_docs, doc_id="doc_id", text="text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string"))
    texts = [(r[0], r[1]) for r in edge_rows()] + [(100 + k, t) for k, t in enumerate(tricky)]
    got = sorted((r["doc_id"] or -1, base_of(r["spans"])) for r in secrets.secret_rows(docs).collect())
    assert got == sorted((i or -1, slow_spans(t)) for i, t in texts)
    assert secrets.secret_rows(empty_docs).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[13] == "é <SECRET>\"" and clean[14] == "<SECRET> ünï" and clean[108] == "é" * 5 + "<SECRET>\n<SECRET>'"
    assert secrets.redact(edge_docs).columns == edge_docs.columns


def test_secret_query_matches_slow_scan(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op6_secret_scans"](spark, sf).collect():
        assert base_of(r["spans"]) == slow_spans(texts[r["doc_id"]])


def test_trigram_queries_are_mandatory():
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query("AKIA[A-Z]+") == frozenset([frozenset(["aki", "kia"])])
    two = secrets.trigram_query("(?:abcd|xyz)[0-9]*")
    assert two == frozenset([frozenset(["abc", "bcd"]), frozenset(["xyz"])])
    assert secrets.trigram_query("abc?") == secrets.ANY


def auc(pairs):
    pairs = sorted(pairs)
    pos = sum(y for _, y in pairs)
    ranks = sum(k + 1 for k, (_, y) in enumerate(pairs) if y)
    return (ranks - pos * (pos + 1) / 2) / (pos * (len(pairs) - pos))


@pytest.mark.parametrize(("query", "label", "modulus", "out", "least"), [("op9_toxicity", "toxic", 4, 2, 0.9), ("op10_quality", "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, label, modulus, out, least):
    sf = "/root/testdata/sf0.1"
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label).collect())
    rows = QUERIES[query](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == out) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert auc([(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]) >= least


def test_scores_on_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (9, None, None), (4, 1, 1)], "doc_id long, toxic int, quality int")
    for module, score in ((toxicity, toxicity.toxicity), (quality, quality.quality)):
        for table in (labels, labels.limit(0)):
            model = module.taught(edge_docs, table)
            got = score(edge_docs, model).collect()
            assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
            assert score(empty_docs, model).count() == 0
    assert toxicity.drop_toxic(edge_docs, labels.limit(0)).columns == edge_docs.columns


def test_grammar_tells_scopes_apart():
    g = toxicity.learn([])
    at = lambda text: {toxicity.EVENTS[k]: int(n) for k, n in enumerate(g.events(text)) if n}
    assert list(at("you are an idiot")) == [("B", 1, 0, 0)]
    assert list(at("this is not stupid")) == [("B", 0, 1, 0)]
    assert list(at("they said he is a moron")) == [("B", 1, 0, 1)]
    assert list(at("it was said. A moron")) == [("B", 0, 0, 0)]
    assert ("T", 0, 0, 0) in at("I will kill you") and ("T", 1, 0, 0) not in at("fine\nkill")
    assert g.score("you are a worthless idiot, you scum") > 0.3 > g.score("a calm sentence about the weather")
    assert g.score(None) == g.score("")


def test_words_stand_between_white_space_of_any_kind():
    assert set(toxicity.BLANKS) == {c for c in map(chr, range(0x110000)) if c.isspace() and len(f"a{c}b".splitlines()) == 1}
    g = toxicity.learn([])
    text = "you are a worthless idiot and I will kill you you scum"
    assert g.score(text) > 0.3
    for blank in toxicity.BLANKS:
        assert (g.features(text.replace(" ", blank)) == g.features(text)).all()
    for end in ("\r", "\r\n", "\x0b", "\f", "\x85", "\u2028"):
        assert (g.features(f"it was said{end}a moron{end}you fool") == g.features("it was said\na moron\nyou fool")).all()


def test_attention_gradient_is_the_slope():
    r = np.random.default_rng(0)
    model = quality.Attention(np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    x, starts, y = r.normal(size=(9, quality.WIDTH)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(f := model.forward(x, starts)["y"]) + (1 - y) * np.log(1 - f))
    grad = model.gradient(model.forward(x, starts), starts, y)
    for name in model.NAMES:
        flat = model.p[name].reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            held = flat[k]
            flat[k] = held + 1e-5
            up = loss()
            flat[k] = held - 1e-5
            down = loss()
            flat[k] = held
            assert math.isclose((up - down) / 2e-5, grad[name].reshape(-1)[k], rel_tol=1e-3, abs_tol=1e-7)


def slow_nearest(rows, every=50, k=5):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, (i, v) in enumerate(ok):
        if i is not None and i % every == 0:
            near = [(-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), j is None, j or 0) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v)]
            out.setdefault(i, []).append([(j, -s) for s, _, j in sorted(near)[:k]])
    return out


def test_neighbours_on_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.6, 0.8]), (1, [2.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (50, [0.0, 1.0]), (51, [1.0, 2.0, 3.0]), (None, [1.0, 0.2]), (100, [3.0, 2.0, 1.0])]
    wide = [(*r, 1, "s", 5) for r in rows]
    got = neighbours.nearest(spark.createDataFrame(wide, "vec_id long, embedding array<double>, rank int, score string, row_key long")).collect()
    want = slow_nearest(rows)
    for q in (50, 100):
        own = sorted((r["rank"], r["vec_id"] or 0, r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in own] == [i for i, _ in want[q][0]] and np.allclose([s for *_, s in own], [s for _, s in want[q][0]], atol=1e-12)
    assert len([r for r in got if r["query_id"] == 0]) == 10
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbour_recall(spark, sf):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = slow_nearest(rows)
    got = {}
    for r in QUERIES["op7_nearest"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = sum(i in got[q] for q, (near,) in want.items() for i, _ in near)
    assert hits >= 0.9 * sum(len(near) for (near,) in want.values())
    assert all(len(x) == 5 for x in got.values())


def test_language_fusion_overrules_weak_evidence(spark, sf):
    model = language.taught(spark.read.parquet(f"{sf}/documents.parquet"))
    page = lambda lang, body: f'<html lang="{lang}"><style>p</style><p>{body}</p></html>'
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 600").groupBy("lang").agg({"text": "first"}).collect())
    rows = [(k, f"http://a.example.{'de' if k % 2 else 'com'}/{lang}/x", page(lang, texts[lang])) for k, lang in enumerate(["de", "en", "es", "fr"] * 5)]
    rows += [(100, "http://b.example.com/de/1", page("de", texts["en"])), (101, None, None), (102, "not a url", ""), (103, "http://a.example.de/", "<p>12 34</p>"), (None, "http://a.example.com/", page("xx", texts["fr"])), (1, rows[1][1], rows[1][2])]
    got = {}
    for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string, host string, t0 string, lang string".split(", host")[0]), model).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert all(got[k][0]["lang"] == lang for k, lang in enumerate(["de", "en", "es", "fr"] * 5)) and len(got[1]) == 2
    assert got[100][0]["lang"] == "en" and got[100][0]["declared_lang"] == "de" and got[None][0]["declared_lang"] == "other"
    assert all(0 < r["confidence"] <= 1 for rs in got.values() for r in rs)
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_language_query_agrees_with_markup_mostly(spark, sf):
    rows = QUERIES["op3_language_id"](spark, sf).collect()
    assert sum(r["lang"] == r["declared_lang"] for r in rows) >= 0.97 * len(rows)


def test_every_language_teaches(spark):
    letters = "abcdefghijklmnop"
    word = lambda k: letters[k // 16] * 3 + letters[k % 16] * 2
    rows = [(k, f"{word(k)} " * 30, f"l{k:02d}") for k in range(70)] + [(100 + k, "zq " * 70_000, "long") for k in range(3)]
    rows += [(200, "none of l00 " * 20_000, "l00"), (201, None, "l00"), (200, "none of l00 " * 20_000, "l00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.taught(docs)
    assert model.languages == sorted({lang for *_, lang in rows}) and len(model.languages) == 71
    assert np.array_equal(model.logs, language.learn([(t, lang) for _, t, lang in rows[:-2]]).logs)
    best = lambda t: model.languages[int(np.argmax(model.log_likelihood(t)))]
    assert best(f"{word(69)} " * 9) == "l69" and best("zq zq zq") == "long"


HIDDEN = re.compile(r"(?is)<(script|style|nav|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b|<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([a-z]{2,3})\b")


def slow_declared(page):
    m = DECLARED.search(page or "")
    return (m[1] or m[2]).lower() if m else "none"


def test_page_patterns_are_those_of_one_expression():
    r = random.Random(1)
    bits = ["<script", "<style>", "</script>", "</style >", "<!--", "-->", "<html ", "<meta ", "lang=", "lang = 'de'", "content-language", " content=", "content='fr'", ">", "<", "a", " ", "\n", "en", "xml:lang=es", "nav", "<NAV>", "</nav>"]
    for _ in range(30_000):
        page = "".join(r.choices(bits, k=r.randint(1, 14)))
        assert language.declared(page) == slow_declared(page), page
        assert language.visible(page) == html.unescape(re.sub(r"<[^>]*>", " ", HIDDEN.sub(" ", page))), page


def took(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


@pytest.mark.parametrize("unit", ["<script>", "<meta content-language ", "<", "<html ", "<!--", "</script ", "<html lang"])
def test_unclosed_tags_cost_a_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    assert took(language.visible, page) + took(language.declared, page) < 10


def slow_identify(rows, model):
    """The fusion, page by page in plain Python."""
    langs, n = model.languages, len(model.languages)
    each = []
    for key, url, page in rows:
        host, domain, at = language._address(url, langs)
        said = slow_declared(page)
        said = said if said in langs or said == "none" else "other"
        t = np.array(model.log_likelihood(html.unescape(re.sub(r"<[^>]*>", " ", HIDDEN.sub(" ", page or "")))))
        each.append((key, host, domain, at, said, t, np.exp(t) / np.exp(t).sum()))
    every = sum(x[6] for x in each) + language.SMOOTH
    every = every / every.sum()

    def worth(value, k):
        if value == "none":
            return np.zeros(n)
        counts = {v: sum([x[6] for x in each if x[k] == v], np.zeros(n)) + language.SMOOTH for v in [*langs, "other"]}
        return np.log(counts[value] / sum(counts.values()))

    out = []
    for key, host, domain, at, said, t, p in each:
        of_domain, of_host = [x[6] for x in each if x[2] == domain], [x[6] for x in each if x[1] == host]
        prior = (sum(of_domain) - p + language.DOMAIN_WEIGHT * every) / (len(of_domain) - 1 + language.DOMAIN_WEIGHT)
        prior = (sum(of_host) - p + language.HOST_WEIGHT * prior) / (len(of_host) - 1 + language.HOST_WEIGHT)
        z = t + np.log(prior) + worth(said, 4) + worth(at, 3)
        z = np.exp(z - z.max())
        out.append((key, langs[int(z.argmax())], float((z / z.sum()).max()), langs[int(t.argmax())], said, at, host))
    return out


def test_language_query_matches_slow_fusion(spark, sf):
    model = language.taught(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    want = {r[0]: r for r in slow_identify(rows, model)}
    got = [tuple(r) for r in QUERIES["op3_language_id"](spark, sf).collect()]
    assert len(got) == len(rows)
    for r in got:
        w = want[r[0]]
        assert r[:2] + r[3:] == w[:2] + w[3:] and abs(r[2] - w[2]) < 2e-6


def slow_events(g, text):
    """Events clause by clause, from distances between words."""
    found = {}
    letters = "".join(g.letters(w) for w in " \x00 ".join(text.lower().splitlines()).split())
    for clause in letters.split("."):
        near = lambda i, classes, words: any(c in classes for c in clause[max(0, i - words) : i])  # noqa: E731, B023
        for i, c in enumerate(clause):
            event = None
            if c in "ABCDET":
                event = (c, int(near(i, "Y", 5)), int(near(i, "N", 3)), int(near(i, "R", len(clause))))
            elif c == "Y" and near(i, "ABCDET", 3):
                event = ("Y", 1, 0, 0)
            if event:
                found[event] = found.get(event, 0) + 1
    return found


def toxic_text(r):
    words = ["you", "idiot", "never", "said", "kill", "calm", "day", "stupid.", "they", "scum,", "word;", "line\nend", "worthless", "not", "the"]
    return " ".join(r.choices(words, k=r.randint(0, 60)))


def test_events_match_distances():
    g, r = toxicity.learn([]), random.Random(3)
    for _ in range(500):
        text = toxic_text(r)
        assert {toxicity.EVENTS[k]: int(n) for k, n in enumerate(g.events(text)) if n} == slow_events(g, text), text


def labelled_docs(spark):
    r = random.Random(5)
    calm = lambda n: " ".join(r.choices([f"calm{k}" for k in range(40)], k=n))
    rows = [(k, f"{calm(40)} {'you vile zorgon ' * 3 if k % 3 == 0 else ''}{calm(20)}", int(k % 3 == 0)) for k in range(240)]
    rows += [(300, calm(60_000) + " zorgon you idiot", 1), (301, None, 1), (302, "", 0)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    return rows, docs, spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, toxic int, quality int")


def taught_rows(spark, docs, labels, label, modulus, out):
    rows = teaching_texts(docs, labels, label, modulus, out, 12_000).orderBy("doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % modulus != out for r in rows)
    return rows


def test_a_grammar_taught_in_place_is_the_one_learned_here(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED_WORDS", 50)
    rows, docs, labels = labelled_docs(spark)
    got = toxicity.taught(docs, labels)
    held = taught_rows(spark, docs, labels, "toxic", toxicity.MODULUS, toxicity.HELD_OUT)
    assert max(len(r["text"]) for r in held) > 200_000 or zlib.crc32(b"300") % 4 == 2
    want = toxicity.learn([(r["text"], r["label"], r["half"]) for r in held])
    assert got.words == want.words and got.beginnings == want.beginnings and "zorgon" in got.words
    assert np.allclose(got.weights, want.weights) and math.isclose(got.bias, want.bias, rel_tol=1e-9)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, got).collect()}
    for i, text, _ in rows:
        n = np.zeros(len(toxicity.EVENTS))
        for event, k in slow_events(got, text or "").items():
            n[toxicity.EVENTS.index(event)] = k
        length = 1 + sum(c in toxicity.BLANKS for c in text or "")
        x = [*np.log1p(n), math.log1p(100 * n.sum() / length), math.log(length) if n.any() else 0.0]
        assert math.isclose(scores[i], 1 / (1 + math.exp(-(np.dot(x, got.weights) + got.bias))), rel_tol=1e-9)


def slow_quality(model, text):
    """Passages and attention, one at a time in plain Python."""
    words = (text or "").split()
    size = max(quality.PASSAGE, math.ceil(len(words) / quality.MOST_PASSAGES))
    starts = list(range(0, max(1, len(words) - size // 4), size)) if words else []
    bags = []
    for a, b in zip(starts, [*starts[1:], len(words)]):
        part = words[a:b]
        n, rows, shares = len(part), [], [0.0] * quality.BUCKETS
        for w in part:
            marks = sum(not (c.isalnum() or c == "_" or c.isspace()) for c in w)
            letters = [c for c in w if c.isalpha()]
            rows.append([min(len(w), 30) / 10, marks / len(w), marks >= 2, not letters, len(letters) > 1 and all(c.isupper() for c in letters), w[0].isupper(), sum(c.isdigit() for c in w) / len(w), len(w) <= 3, w[-1] in ".!?", w[-1] in ",;:"])
            shares[zlib.crc32("".join(letters).lower().encode()) % quality.BUCKETS] += 1 / n
        means = [sum(float(r[k]) for r in rows) / n for k in range(10)]
        again = sum(i > 0 and words[i] == words[i - 1] for i in range(a, b)) / n
        bags.append([*means, len(set(part)) / n, again, again > 0.2, math.log(n) / 4, means[1] > 0.25, *shares])
    p, hidden, raw = model.p, [], []
    for x in bags or [[0.0] * quality.WIDTH]:
        h = np.tanh(np.clip((np.array(x, float) - model.mean) / model.spread, -6, 6) @ p["E"] + p["e"])
        hidden.append(h)
        raw.append(math.exp(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])))
    z = sum(h * (a / sum(raw)) for h, a in zip(hidden, raw))
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["b"][0])))


def test_a_quality_model_taught_in_place_is_the_one_learned_here(spark):
    rows, docs, labels = labelled_docs(spark)
    got = quality.taught(docs, labels)
    want = quality.learn([(r["text"], r["label"]) for r in taught_rows(spark, docs, labels, "quality", quality.MODULUS, quality.HELD_OUT)])
    assert all(np.allclose(got.p[k], want.p[k]) for k in got.NAMES)
    for r in quality.quality(docs, got).collect():
        assert abs(r["score"] - slow_quality(got, dict(x[:2] for x in rows)[r["doc_id"]])) < 1e-4
    assert all(len(quality.Measures().passages("w " * n)) <= quality.MOST_PASSAGES for n in (1, 63, 4096, 4097, 5000, 100_000))


def test_long_texts_cost_a_linear_time():
    g = toxicity.learn([])
    assert took(g.score, "calm words and idiot " * 125_000) + took(g.score, "calm words and others " * 125_000) < 20


@pytest.mark.parametrize("n", [8_000, 50_000])
def test_many_secrets_in_one_text(spark, n):
    docs = spark.createDataFrame([(1, "token=abcdef " * n), (2, "eyJ" * n), (3, "eyJab.eyJcd.ef, and eyJab.eyJ")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.secret_rows(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert got[1]["n_assign"] == n and got[1]["spans"] == ",".join(f"assign:{13 * k}:{13 * k + 12}" for k in range(n))
    assert clean[1] == "<SECRET> " * n and got[2]["spans"] == "" and clean[2] == "eyJ" * n
    assert got[3]["spans"] == "web_token:0:14" and clean[3] == "<SECRET>, and eyJab.eyJ"
    assert time.time() - began < 90


def test_large_ids_beside_a_null_one(spark):
    r, big = np.random.default_rng(1), 9007199254741050
    rows = [(None if k == 7 else big + k, r.normal(size=4).tolist()) for k in range(60)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = slow_nearest(rows)
    assert {q for q, _ in rows if q and q % 50 == 0} == {x["query_id"] for x in got}
    for q, (near,) in want.items():
        assert [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == [i if i else None for i, _ in near]
