"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of about PASSAGE words; only the document has a label. Every passage is measured, by the
shape of its words and by which words they are (shares of BUCKETS hash buckets), and encoded; a gated attention (tanh and
sigmoid branches, multiplied) says how much each passage counts; the weighted sum of the encodings is scored. Encoder,
attention and scorer are learned together from document labels.

All words of a text are read. A text of more than PASSAGE * MOST_PASSAGES words has longer passages instead of more, in
teaching and in scoring alike, so that no bag has more than MOST_PASSAGES.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, pick, release
from .labelled import remainder, teaching_texts

PASSAGE, MOST_PASSAGES = 64, 64
#: Measures of shape, and the hash buckets of words.
SHAPES, BUCKETS = 15, 32
WIDTH = SHAPES + BUCKETS
#: At most so many labelled rows teach the model.
TEACHING_ROWS = 8_000
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0
HIDDEN, GATES, STEPS, RATE = 16, 8, 400, 0.02
#: Words kept with their measures in a table, which starts anew when it is full, and the longest that are kept.
MEMO_WORDS, MEMO_CHARS = 150_000, 64
_MARKS = re.compile(r"[^\w\s]")


class Measures:
    """Measures of words, kept by word number, and of the passages made of them."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.used = 0
        self.table = np.zeros((1024, 10), np.float32)
        self.bucket = np.zeros(1024, np.int64)

    def _add(self, word: str) -> int:
        n, marks = len(word), len(_MARKS.findall(word))
        letters = [c for c in word if c.isalpha()]
        upper = sum(c.isupper() for c in letters)
        k, self.used = self.used, self.used + 1
        if n <= MEMO_CHARS:
            self.number[word] = k
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
        self.bucket[k] = zlib.crc32("".join(letters).lower().encode()) % BUCKETS
        self.table[k] = (
            min(n, 30) / 10,
            marks / n,
            float(marks >= 2),
            float(not letters),
            float(len(letters) > 1 and upper == len(letters)),
            float(word[0].isupper()),
            sum(c.isdigit() for c in word) / n,
            float(n <= 3),
            float(word[-1] in ".!?"),
            float(word[-1] in ",;:"),
        )
        return k

    def passages(self, text: str | None) -> np.ndarray:
        """One row of measures for each passage; a text without words is one passage of zeros."""
        words = (text or "").split()
        if self.used >= MEMO_WORDS:
            self.number.clear()
            self.used = 0
        if not words:
            return np.zeros((1, WIDTH), np.float32)
        known, add = self.number.get, self._add
        ids = np.array([k if (k := known(w)) is not None else add(w) for w in words], np.int64)
        size = max(PASSAGE, -(-len(ids) // MOST_PASSAGES))
        starts = np.arange(0, max(1, len(ids) - size // 4), size)  # a short rest belongs to the last passage
        sizes = np.diff(np.r_[starts, len(ids)])
        means = np.add.reduceat(self.table[ids], starts, axis=0) / sizes[:, None]
        which = np.repeat(np.arange(len(starts)), sizes)
        again = np.zeros(len(ids), np.float32)
        again[1:] = ids[1:] == ids[:-1]
        pairs = np.sort(which << 32 | ids)
        new = np.r_[True, pairs[1:] != pairs[:-1]]
        different = np.bincount((pairs >> 32)[new], minlength=len(starts)) / sizes
        repeats = np.add.reduceat(again, starts) / sizes
        shares = np.bincount(which * BUCKETS + self.bucket[ids], minlength=len(starts) * BUCKETS).reshape(-1, BUCKETS) / sizes[:, None]
        return np.c_[means, different, repeats, repeats > 0.2, np.log(sizes) / 4, means[:, 1] > 0.25, shares].astype(np.float32)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


class Attention:
    """tanh encoder, gated attention, logistic scorer."""

    NAMES = ("E", "e", "V", "U", "w", "c", "b")

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.spread = mean, spread
        self.p = {"E": r.normal(0, 0.4, (d, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATES)), "U": r.normal(0, 0.3, (HIDDEN, GATES)), "w": r.normal(0, 0.3, GATES), "c": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def forward(self, s: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All that the bags of scaled passages, which begin at starts, give rise to; y are their scores."""
        p = self.p
        h = np.tanh(s @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (t * g) @ p["w"]
        sizes = np.diff(np.r_[starts, len(s)])
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a = raw / np.repeat(_sums(raw, starts), sizes)
        z = _sums(h * a[:, None], starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"s": s, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "sizes": sizes}

    def gradient(self, f: dict[str, np.ndarray], starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(label)
        d = (f["y"] - label) / n
        dz = d[:, None] * p["c"]
        dz_each = np.repeat(dz, f["sizes"], axis=0)
        da = (dz_each * f["h"]).sum(axis=1)
        draw = f["a"] * (da - np.repeat(_sums(f["a"] * da, starts), f["sizes"]))
        dtg = draw[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = dz_each * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"E": f["s"].T @ dpre, "e": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ draw, "c": f["z"].T @ d, "b": np.array([d.sum()])}

    def scores(self, bags: list[np.ndarray]) -> list[float]:
        if not bags:
            return []
        starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]].astype(np.int64)
        return self.forward(self.scaled(np.concatenate(bags).astype(float)), starts)["y"].tolist()


def learn(rows: list[tuple[str, int]]) -> Attention:
    """The model from labelled texts, measured here."""
    measures = Measures()
    return _fitted([measures.passages(t) for t, _ in rows], [y for _, y in rows])


def _fitted(bags: list[np.ndarray], labels: list[int]) -> Attention:
    """The model from bags, by Adam over all of them; without both labels every score is their share, or 0.5."""
    label = np.array([float(y > 0) for y in labels])
    if len(set(label.tolist())) < 2:
        model = Attention(np.zeros(WIDTH), np.ones(WIDTH))
        model.p["c"][:] = 0
        model.p["b"][:] = 0 if not len(label) else (3.0 if label[0] else -3.0)
        return model
    x = np.concatenate(bags).astype(float)
    starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
    model = Attention(x.mean(0), x.std(0) + 1e-3)
    x = model.scaled(x)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, STEPS + 1):
        grad = model.gradient(model.forward(x, starts), starts, label)
        for k in model.NAMES:
            g = grad[k] + 1e-4 * model.p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def taught(docs: DataFrame, labels: DataFrame) -> Attention:
    """learn() of at most TEACHING_ROWS labelled rows, whole texts of any length, null ones left out.

    Passages are measured where the texts are; the driver gets WIDTH single-precision numbers for each, and a document has
    at most MOST_PASSAGES: 96 MB if every teaching document were that long.
    """
    rows = teaching_texts(docs, labels, "quality", MODULUS, HELD_OUT, TEACHING_ROWS)

    def make():
        measures = Measures()

        def work(columns):
            bags = [measures.passages(t).astype("<f4") for t in columns[1]]
            return {"doc_id": columns[0], "label": columns[2], "bag": [b.tobytes() for b in bags]}

        return work

    got = arrow_rows(rows.select("doc_id", "text", "label"), "doc_id long, label int, bag binary", make).toArrow().sort_by("doc_id")
    release(rows)
    return _fitted([np.frombuffer(x.as_buffer(), "<f4").reshape(-1, WIDTH) for x in got["bag"]], got["label"].to_pylist())


def quality(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.3).

    Null text counts as empty, which is one passage of zeros; null and repeated ids are kept; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held, measures = shared.value, Measures()

        def work(columns):
            scores = held.scores([measures.passages(t) for t in columns[2]])
            return {"doc_id": columns[0], "held_out": columns[1], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

        return work

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "text")
    return arrow_rows(rows, "doc_id long, held_out boolean, score double, predicted int", make)
