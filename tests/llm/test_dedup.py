import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tesserine.llm import exact_dedup, line_dedup, simhash
from tesserine.llm.queries import QUERIES

from .conftest import edge_rows


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Smallest member of each fingerprint's component, over a list of different fingerprints."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    every = np.array(prints, np.uint64)
    for k, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(every[k + 1 :] ^ every[k]) <= 3):
            a, b = find(p), find(prints[k + 1 + int(j)])
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def want_near(rows):
    prints = [slow_print(t) for _, t in rows]
    comp = slow_components(sorted(set(prints)))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    return sorted((i if i is not None else -1, f"{p:016x}", least.get(comp[p], -1)) for (i, _), p in zip(rows, prints))


def got_near(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in df.collect())


def test_simhash_on_edges(edge_docs, empty_docs):
    assert got_near(simhash.near_groups(edge_docs)) == want_near([r[:2] for r in edge_rows()])
    assert simhash.near_groups(empty_docs).count() == 0
    left = simhash.drop_near_copies(edge_docs)
    assert left.columns == edge_docs.columns
    # 5 (twice) is a near copy of 4 and 16; 2, 3 and the one without id are copies of 1; blank texts are one group
    ids = sorted(i for i in (r["doc_id"] for r in left.collect()) if i is not None)
    assert 1 in ids and 4 in ids and not {2, 3, 16} & set(ids) and ids.count(9) == 2 and 6 in ids and not {7, 8} & set(ids)


def test_simhash_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got_near(QUERIES["op1_simhash"](spark, sf)) == want_near(rows)


@pytest.mark.parametrize("tile", [8192, 16])
def test_links_of_chains_and_hot_anchors(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(4)
    prints = {r.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    at = r.getrandbits(64)
    for _ in range(60):  # a chain: each link at most 3 bits
        for _ in range(r.randint(1, 3)):
            at ^= 1 << r.randrange(64)
        prints.add(at)
    centre = r.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(20, 32)}
    prints = sorted(prints)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "print long"))
    got = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    want = slow_components(prints)
    groups = lambda pairs: sorted(sorted(g) for g in _classes(pairs) if len(g) > 1)
    back = lambda x: int(np.int64(x).view(np.uint64))
    assert groups([(back(a), back(b)) for a, b in got.items()]) == groups(list(want.items()))


def _classes(pairs):
    out = defaultdict(set)
    for node, root in pairs:
        out[root].add(node)
    return out.values()


def test_anchors_cover_every_single_bit_change():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    for bit in range(31):
        anchor, own, home = simhash.anchors(x)
        homes = {(int(p), int(a) >> 31): int(a) for a, p, h in zip(anchor, own, home) if h}
        y = x ^ np.uint64(1 << bit)
        a2, o2, _ = simhash.anchors(y)
        sent = {(int(p), int(a)) for a, p in zip(a2, o2)}
        assert all((int(q), homes[int(p), 0]) in sent for p, q in zip(x, y))


def want_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for text, held in groups.items():
        best = min(held)
        keep = None if best[1] else best[2]
        for row in held:
            out.append((-1 if row[1] else row[2], -1 if keep is None else keep, len(held), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out), len(groups)


def test_exact_dedup_on_edges(edge_docs, empty_docs):
    rows = exact_dedup.exact_groups(edge_docs).collect()
    want, groups = want_exact([r[:2] for r in edge_rows()])
    null = lambda x: -1 if x is None else x
    assert sorted((null(r["doc_id"]), null(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == groups
    assert exact_dedup.exact_groups(empty_docs).count() == 0
    left = exact_dedup.drop_exact_copies(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == groups


def test_quotient_filters_merge_losslessly():
    r = np.random.default_rng(3)
    prints = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    prints = np.concatenate([prints, prints[:700], prints[:90]])
    r.shuffle(prints)
    parts = [exact_dedup.QuotientFilter.from_bytes(exact_dedup.QuotientFilter.of(p).to_bytes()) for p in np.array_split(prints, 7)]
    whole = exact_dedup.QuotientFilter.merged(parts)
    values, counts = np.unique(prints, return_counts=True)
    assert np.array_equal(whole.prints(), values) and np.array_equal(whole.counts, counts)


def want_lines(rows, least):
    sites = defaultdict(set)
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, t, site in rows:
        for line in (t or "").split("\n"):
            if site is not None:
                sites[bare(line)].add(site)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not bare(x) or len(sites[bare(x)]) < least]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_on_edges(edge_docs, empty_docs):
    got = line_dedup.strip_boilerplate(edge_docs, min_sites=2).collect()
    want = want_lines([(r[0], r[1], r[3]) for r in edge_rows()], 2)
    assert sorted((-1 if r["c0"] is None else r["c0"], r["n_lines"], r["n_removed"], r["clean"]) for r in got) == want
    assert line_dedup.strip_boilerplate(empty_docs).count() == 0


def test_line_dedup_near_and_far_from_the_threshold(spark):
    rows = [(k, "everywhere\nunique %d\n%s" % (k, "four sites" if k < 4 else "five sites" if k < 9 else "own %d" % k), f"site{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["c0"], r["n_lines"], r["n_removed"], r["clean"]) for r in line_dedup.strip_boilerplate(docs).collect())
    assert got == want_lines(rows, line_dedup.MIN_SITES)
