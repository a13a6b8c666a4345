"""SimHash near-dedup with anchor-point covering.

A link joins fingerprints with at most LINK_BITS = 3 differing bits, so one of a fingerprint's two halves differs in at
most one bit. For a half, 31 of its bits are searched with the perfect Hamming code [31, 26] as anchors: its covering
radius is 1, so every fingerprint lives at one anchor, and it is also sent to every anchor within covering radius plus
threshold, 1 + 1 = 2 bits: that is 16 anchors, or 1 if it is a code word itself. Fingerprints that differ in one bit of
the half therefore meet at the anchor where one of them lives. Each anchor compares those that live there with all that
came, over all 64 bits, and hands on a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, column_of, cut, release, with_row_key, without_rows

LINK_BITS = 3
#: An anchor with more fingerprints is compared in squares of about so many on a side, in as many tasks as there are squares.
TILE = 8192
_MASK31 = np.uint64((1 << 31) - 1)
#: Numbers of 64-bit comparisons done at once.
_AT_ONCE = 1 << 21


def fingerprint(text: str | None) -> int:
    """64 bits: bit i is 1 if it is set in over half the XXH64 (seed 42) of the 3-word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly [\\x20\\x09-\\x0D]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: n - 1].tolist()]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def _syndromes(x: np.ndarray) -> np.ndarray:
    """The 5-bit syndrome of 31-bit words under the Hamming code whose bit i - 1 has column i."""
    out = np.zeros(len(x), np.uint64)
    for k in range(5):
        check = np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1))
        out |= (np.bitwise_count(x & check).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


def _near_masks() -> np.ndarray:
    """For each syndrome the 16 bit patterns that lead to a code word within 2 bits; syndrome 0 has one, repeated."""
    masks = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        masks[s, 0] = 1 << (s - 1)
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        masks[s, 1:] = [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    return masks


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, lives there) for fingerprints as uint64; bit 31 of an anchor tells the half."""
    masks, out = _near_masks(), ([], [], [])
    for half in (0, 1):
        x = (prints >> np.uint64(32 * half)) & _MASK31
        s = _syndromes(x).astype(np.int64)
        every = (x[:, None] ^ masks[s]) | np.uint64(half << 31)
        home = np.zeros(every.shape, bool)
        home[:, 0] = True
        use = home | (s != 0)[:, None]
        out[0].append(every[use])
        out[1].append(np.broadcast_to(prints[:, None], every.shape)[use])
        out[2].append(home[use])
    return tuple(np.concatenate(x) for x in out)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of any number to a star forest with the same components: each node once, with the smallest of its component."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def _links_of_groups(group: np.ndarray, prints: np.ndarray, home: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole groups (rows sorted by group). side: bit 0 compares as one that lives there, bit 1 as one that came."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    which = np.searchsorted(starts, np.arange(len(group)), side="right") - 1
    left = np.flatnonzero(home & ((side & 1) > 0) & ((ends - starts)[which] > 1))
    reach = (ends - starts)[which[left]]
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []

    def shrink() -> None:
        a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
        found_a[:], found_b[:] = [a], [b]

    edge, at = np.cumsum(reach), 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + _AT_ONCE, side="right")))
        some, n = left[at:to], reach[at:to]
        i = np.repeat(some, n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[which[some]], n)
        near = (np.bitwise_count(prints[i] ^ prints[j]) <= LINK_BITS) & (prints[i] != prints[j]) & ((side[j] & 2) > 0)
        if near.any():
            found_a.append(prints[i[near]])
            found_b.append(prints[j[near]])
            if sum(map(len, found_a)) > 4 * _AT_ONCE:
                shrink()
        at = to
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    shrink()
    return found_a[0], found_b[0]


def _compare(batches):
    """Sorted rows (anchor, tile, print, home, side) to links (a, b); a group that a batch cuts waits for the next batch."""
    held: list[np.ndarray] | None = None

    def out(cols):
        a, b = _links_of_groups(cols[0], cols[1], cols[2], cols[3])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        anchor, tile, prints, home, side = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cols = [anchor * np.int64(1 << 31) + tile, prints.view(np.uint64), home, side]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left")) if len(cols[0]) else 0
        if last:
            yield out([c[:last] for c in cols])
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield out(held)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of the different fingerprints in column print; their components are those of all links."""

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                anchor, own, home = anchors(batch.column(0).slice(at, 4096).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), pa.array(home)], names=["anchor", "print", "home"])

    sent = prints.select("print").mapInArrow(spread, "anchor long, print long, home boolean")
    # Anchors that would be too much for one task are few; their rows go to squares of tiles.
    large = cut(sent.groupBy("anchor").count().where(F.col("count") > TILE).select(F.col("anchor").alias("large"), F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    if large.isEmpty():
        tiled = sent.select("anchor", F.lit(0).cast("long").alias("tile"), "print", "home", F.lit(3).alias("side"))
    else:
        own = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
        # as one that lives there: row `own` of the squares; as one that came: column `own`
        cell = F.explode(
            F.concat(
                F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct((own * F.col("tiles") + k).cast("long").alias("tile"), F.when(k == own, 3).otherwise(1).alias("side"))),
                F.filter(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct((k * F.col("tiles") + own).cast("long").alias("tile"), F.when(k == own, 0).otherwise(2).alias("side"))), lambda x: x["side"] > 0),
            )
        )
        joined = sent.join(large, F.col("anchor") == F.col("large"), "left")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("tile"), F.lit(3).alias("side")))
        some = joined.where("large is not null").select("anchor", "print", "home", cell.alias("cell"))
        rest = joined.where("large is null").select("anchor", "print", "home", F.explode(whole).alias("cell"))
        tiled = some.union(rest).select("anchor", "cell.tile", "print", "home", "cell.side")
    met = tiled.select("anchor", "tile", "print", "home", "side").repartition("anchor", "tile").sortWithinPartitions("anchor", "tile")
    return met.mapInArrow(_compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node of the component.

    Rounds of taking the smallest label around and then the label's own label, each written to the shared folder; stars
    and chains end in a number of rounds that grows with the logarithm of their length.
    """
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("around"))
        hooked = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "around").alias("root"))
        label = labels.select(F.col("node").alias("of"), F.col("root").alias("further"))
        new = cut(hooked.join(label, F.col("root") == F.col("of")).select("node", "was", F.least("root", "further").alias("root")))
        release(labels)
        labels = new
        if new.where("root <> was").isEmpty():
            release(both)
            return new.select("node", "root")


def _hex(column: str) -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, root and the row's file_key, row_key.

    root names a component even where ids are null or repeated.

    component_id is the smallest doc_id that can be reached by links of at most 3 differing bits, a row's own included;
    rows with null doc_id never give their name to a component that has another. Texts of fewer than three words have one
    shingle; without words, and for null, the fingerprint is zero and links like any other. Equal fingerprints are one
    node, however many rows have them. An empty table gives an empty result; other columns are left out.
    """
    return _groups(with_row_key(docs), column_of(docs, id_col), column_of(docs, text_col))


def _groups(keyed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = keyed.select(F.col(id_col).cast("long"), F.col(text_col), "file_key", "row_key")

    def make():
        def work(columns):
            keys, texts, files, at = columns
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()
            return {"doc_id": keys, "print": prints, "file_key": files, "row_key": at}

        return work

    printed = cut(arrow_rows(rows, "doc_id long, print long, file_key long, row_key long", make))
    nodes = cut(printed.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(cut(links(nodes)))
    named = nodes.join(roots, F.col("print") == F.col("node"), "left").select(F.col("print").alias("of_print"), F.coalesce("root", "print").alias("root"), "first")
    first = named.groupBy(F.col("root").alias("of_root")).agg(F.min("first").alias("component_id"))
    classes = named.join(first, F.col("root") == F.col("of_root")).select("of_print", "root", "component_id")
    return printed.join(classes, F.col("print") == F.col("of_print")).select("doc_id", _hex("print").alias("fingerprint"), "component_id", "root", "file_key", "row_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with one row of each component: the one with the smallest doc_id (null last), then the first; all columns stay.

    Any frame will do, also one of a join, a union or a generator: its rows are numbered once.
    """
    keyed = with_row_key(docs)
    rows = cut(_groups(keyed, column_of(docs, id_col), column_of(docs, text_col)))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file_key", "row_key")
    best = rows.groupBy(F.col("root").alias("of_root")).agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1")
    gone = rows.join(best, F.col("root") == F.col("of_root")).where((F.col("best.file_key") != F.col("file_key")) | (F.col("best.row_key") != F.col("row_key")))
    gone = cut(gone.select(F.col("file_key").alias("gone_file"), F.col("row_key").alias("gone_row")))
    release(rows)
    return without_rows(keyed, gone, docs.columns)
