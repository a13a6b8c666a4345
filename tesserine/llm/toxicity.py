"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insults in tiers of weight, threats, targets, negations, words of reported speech, clause ends. Five
small transducers read the classes of a clause: insults and threats emit events, the target, negation and reported-speech
machines keep their scope. Their composition is one deterministic machine whose events say what was matched and in which
scope: an insult aimed at someone, a negated one, a reported one. Event weights are learned; a document's score comes
from its matched clauses.

The insult lexicon holds fixed words and what the teaching rows add: words, and beginnings of words, that toxic documents
use far more often than others.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, column_of, cut, pick, release, with_row_key, without_rows
from .labelled import remainder, teaching_texts

#: At most so many labelled rows teach the lexicon and the event weights.
TEACHING_ROWS = 12_000
THRESHOLD = 0.3
MODULUS, HELD_OUT = 4, 2
#: A word or beginning enters the lexicon with so many toxic documents and at least this log odds ratio.
LEAST_DOCUMENTS, LEAST_WEIGHT = 4, 1.5
#: Lower bounds of the insult tiers A to E, in log odds.
TIERS = (1.5, 2.5, 3.5, 4.5, 5.5)
BEGINNINGS = (4, 5, 6, 7)
#: Words kept with their class, and the longest that are kept.
MEMO_WORDS, MEMO_CHARS = 100_000, 48
#: A task hands on its counts of words when it holds so many.
COUNTED_WORDS = 50_000
#: White space that ends no line.
BLANKS = "\t\x1f \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: Word lists of the grammar.
INSULTS = "idiot moron scum loser pathetic worthless stupid trash clown disgusting imbecile dumb filthy vermin bastard".split()
THREATS = "kill hurt destroy burn stab shoot hang beat smash töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your you're u they them he she his her him dich dir euch sie toi vous tú usted ustedes vosotros".split()
NEGATIONS = "not never neither nor isn't aren't don't doesn't nicht kein keine niemals jamais pas nunca jamás".split()
REPORTS = "said says wrote writes claimed called reported quoted according allegedly sagte schrieb behauptete disait écrit dijo escribió".split()

_INSULT = "ABCDE"
#: Letters of the classes.
THREAT, TARGET, NEGATION, REPORT, OTHER, STOP = "TYNRo."
CLASSES = _INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER + STOP


class Transducer:
    """States with arcs (state, classes, next state, output); the first state is where a clause begins, and STOP leads to it."""

    def __init__(self, start: str, arcs: list[tuple[str, str, str, str | None]]):
        self.start = start
        self.arc = {(a, c): (b, out) for a, classes, b, out in arcs for c in classes}

    def step(self, state: str, letter: str) -> tuple[str, str | None]:
        return (self.start, None) if letter == STOP else self.arc.get((state, letter), (state, None))


def _scope(trigger: str, words: int) -> Transducer:
    """Within `words` words after a trigger the state is 1, 2, ...; it ends by itself and says so as its output."""
    arcs = [(str(i), trigger, "1", None) for i in range(words + 1)]
    other = "".join(c for c in CLASSES if c not in trigger + STOP)
    arcs += [(str(i), other, str((i + 1) % (words + 1)), None) for i in range(1, words + 1)]
    return Transducer("0", arcs)


def _rest_of_clause(trigger: str) -> Transducer:
    return Transducer("0", [("0", trigger, "1", None)])


MACHINES = {
    "insult": Transducer("0", [("0", c, "0", c) for c in _INSULT]),
    "threat": Transducer("0", [("0", THREAT, "0", THREAT)]),
    "target": _scope(TARGET, 5),
    "negation": _scope(NEGATION, 3),
    "report": _rest_of_clause(REPORT),
    "aim": _scope(_INSULT + THREAT, 3),
}


def compose(machines: dict[str, Transducer]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(next state, event or -1) by state and class, and the events, for the product of the machines.

    Events: (what, aimed at a target, negated, reported); what is an insult tier, THREAT, or TARGET for a target that follows.
    """
    names = list(machines)
    events = [(w, *flags) for w in _INSULT + THREAT for flags in product((0, 1), repeat=3)] + [(TARGET, 1, 0, 0)]
    number = {e: i for i, e in enumerate(events)}
    states = [tuple(m.start for m in machines.values())]
    seen, after, out = {states[0]: 0}, [], []
    for state in states:
        row, said = [], []
        of = dict(zip(names, state))
        for letter in CLASSES:
            steps = {n: machines[n].step(of[n], letter) for n in names}
            new = tuple(steps[n][0] for n in names)
            if new not in seen:
                seen[new] = len(states)
                states.append(new)
            row.append(seen[new])
            what = steps["insult"][1] or steps["threat"][1]
            event = (what, int(of["target"] != "0"), int(of["negation"] != "0"), int(of["report"] != "0")) if what else (TARGET, 1, 0, 0) if letter == TARGET and of["aim"] != "0" else None
            said.append(number[event] if event else -1)
        after.append(row)
        out.append(said)
    return np.array(after), np.array(out), events


_NEXT, _OUT, EVENTS = compose(MACHINES)
_LETTER = {c: i for i, c in enumerate(CLASSES)}
_TO, _SAYS = _NEXT.tolist(), _OUT.tolist()
_HIT = re.compile(f"[{_INSULT}{THREAT}]")
_EDGE = re.compile(r"^\W+|\W+$")


class Grammar:
    """The lexicon (word or beginning* to weight) and the weights of the events."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self.weights, self.bias = np.zeros(len(EVENTS) + 2), -3.0
        self.memo: dict[str, str] = {}
        self.fixed = {w: c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def fresh(self) -> Grammar:
        """The same grammar with a memo of its own, which goes with the task that uses it."""
        own = Grammar.__new__(Grammar)
        own.__dict__ = self.__getstate__()
        return own

    def weight(self, word: str) -> float:
        own = self.words.get(word)
        return own if own is not None else max((self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if len(word) >= n), default=0.0)

    def letters(self, word: str) -> str:
        """The class of a word, and STOP if it ends a clause."""
        bare = _EDGE.sub("", word)
        w = self.weight(bare) if bare else 0.0
        tier = sum(w >= t for t in TIERS)
        got = _INSULT[tier - 1] if tier else self.fixed.get(bare, OTHER) if bare else ""
        if word[-1] in ".!?;:\x00":
            got += STOP
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = got
        return got

    def events(self, text: str) -> np.ndarray:
        """How often each event is matched in the clauses of a text."""
        known, letters = self.memo.get, self.letters
        line = "".join([x if (x := known(w)) is not None else letters(w) for w in " \x00 ".join(text.lower().splitlines()).split()])
        counts = np.zeros(len(EVENTS))
        for clause in line.split(STOP):
            if not _HIT.search(clause):
                continue
            state = 0
            for c in clause:
                k = _LETTER[c]
                if (e := _SAYS[state][k]) >= 0:
                    counts[e] += 1
                state = _TO[state][k]
        return counts

    def features(self, text: str) -> np.ndarray:
        n = self.events(text)
        length = 1 + sum(map(text.count, BLANKS))
        return np.concatenate([np.log1p(n), [math.log1p(100 * n.sum() / length), math.log(length) if n.any() else 0.0]])

    def score(self, text: str | None) -> float:
        z = float(self.features(text or "") @ self.weights) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _types(text: str) -> set[str]:
    return {b for w in set(text.lower().split()) if (b := _EDGE.sub("", w))}


def _parts(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in BEGINNINGS if len(w) >= k}


Lexicon = tuple[dict[str, float], dict[str, float]]


def _lexicon(counts: Iterable[tuple[int, str, int, int]], n: int, m: int) -> Lexicon:
    """Words and beginnings with the log odds ratio of their document frequencies, of (kind, word, toxic, other documents).

    kind: 0 a word, 1 a beginning; n toxic documents and m others in all. The fixed insults always have 3 at least.
    """
    tables: Lexicon = ({w: 3.0 for w in INSULTS}, {})
    if n and m:
        for kind, x, k, o in counts:
            w = math.log((k + 0.5) / (n + 1)) - math.log((o + 0.5) / (m + 1))
            if k >= LEAST_DOCUMENTS and w >= LEAST_WEIGHT:
                tables[kind][x] = max(tables[kind].get(x, 0.0), w)
    return tables


def learn_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """The lexicon of (text, label), counted here."""
    have: tuple[Counter, Counter] = Counter(), Counter()
    for t, y in rows:
        words = _types(t)
        have[int(bool(y))].update([(0, w) for w in words] + [(1, w) for w in _parts(words)])
    n = sum(bool(y) for _, y in rows)
    return _lexicon([(kind, x, k, have[0][kind, x]) for (kind, x), k in have[1].items()], n, len(rows) - n)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty, by Newton's method."""
    x1 = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x1.shape[1]), np.full(x1.shape[1], 1.0)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _unfitted(lexicon: Lexicon) -> Grammar:
    """Fixed weights, for want of labels of both kinds."""
    grammar = Grammar(*lexicon)
    grammar.weights = np.array([(1.0 + "ABCDE".find(e[0])) * (0.3 if e[2] or e[3] else 1.0) * (1.5 if e[1] else 1.0) if e[0] in _INSULT + THREAT else 0.5 for e in EVENTS] + [0.0, 0.0])
    return grammar


def learn(rows: list[tuple[str, int, int]]) -> Grammar:
    """A grammar from (text, label, half). Event weights are fitted on halves that the lexicon of the other half classifies."""
    lexicon = learn_lexicon([r[:2] for r in rows])
    if len({y for _, y, _ in rows}) < 2:
        return _unfitted(lexicon)
    others = [Grammar(*learn_lexicon([(t, y) for t, y, h in rows if h != k])) for k in (0, 1)]
    grammar = Grammar(*lexicon)
    grammar.weights, grammar.bias = _fit(np.array([others[h].features(t) for t, _, h in rows]), np.array([y for _, y, _ in rows], float))
    return grammar


def _word_counts(rows: DataFrame) -> DataFrame:
    """(kind, word, t0, t1, o0, o1): toxic and other documents of either half that have it; counted in the tasks first."""

    def count(batches):
        held: Counter = Counter()

        def out():
            keys = list(held)
            got = pa.RecordBatch.from_pydict({"kind": [k[0] for k in keys], "word": [k[1] for k in keys], "class": [k[2] for k in keys], "n": [held[k] for k in keys]}, schema=schema)
            held.clear()
            return got

        for batch in batches:
            for at in range(batch.num_rows):
                text, label, half = (c[at].as_py() for c in batch.columns)
                words, of = _types(text), 2 * (not label) + half
                held.update([(0, w, of) for w in words])
                held.update([(1, w, of) for w in _parts(words)])
                if len(held) >= COUNTED_WORDS:
                    yield out()
        yield out()

    schema = pa.schema([("kind", pa.int32()), ("word", pa.string()), ("class", pa.int32()), ("n", pa.int64())])
    counted = rows.select("text", "label", "half").mapInArrow(count, "kind int, word string, class int, n long")
    sums = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(("t0", "t1", "o0", "o1"))]
    return counted.groupBy("kind", "word").agg(*sums)


def taught(docs: DataFrame, labels: DataFrame) -> Grammar:
    """learn() of at most TEACHING_ROWS labelled rows, whole texts of any length, null ones left out.

    Words are counted, and texts measured, where they are. The driver gets the entries of the lexicon and
    len(EVENTS) + 2 numbers for each teaching row.
    """
    rows = teaching_texts(docs, labels, "toxic", MODULUS, HELD_OUT, TEACHING_ROWS)
    size = {(r["label"] > 0, r["half"]): r["count"] for r in rows.groupBy("label", "half").count().collect()}
    n, m = ([size.get((y, h), 0) for h in (0, 1)] for y in (True, False))
    # of three lexicons: that of each half, and of all
    of = lambda k: [F.col(f"{k}0"), F.col(f"{k}1"), F.col(f"{k}0") + F.col(f"{k}1")]
    total = lambda x: [*x, sum(x)]
    weigh = lambda t, o, a, b: (t >= LEAST_DOCUMENTS) & (F.log((t + 0.5) / (a + 1)) - F.log((o + 0.5) / (b + 1)) >= LEAST_WEIGHT - 1e-9)
    enters = functools.reduce(Column.__or__, [weigh(*x) for x in zip(of("t"), of("o"), total(n), total(m))])
    found = [tuple(r) for r in _word_counts(rows).where(enters).collect()]
    lexicon = _lexicon([(kind, x, t0 + t1, o0 + o1) for kind, x, t0, t1, o0, o1 in found], sum(n), sum(m))
    if not sum(n) or not sum(m):
        release(rows)
        return _unfitted(lexicon)
    halves = [_lexicon([(r[0], r[1], r[2 + h], r[4 + h]) for r in found], n[h], m[h]) for h in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast([Grammar(*halves[1]), Grammar(*halves[0])])
    width = len(EVENTS) + 2

    def make():
        others = [g.fresh() for g in shared.value]

        def work(columns):
            x = np.array([others[h].features(t) for t, h in zip(columns[1], columns[3])])
            return {"doc_id": columns[0], "label": columns[2]} | {f"f{k}": x[:, k] for k in range(width)}

        return work

    got = arrow_rows(rows.select("doc_id", "text", "label", "half"), "doc_id long, label int, " + ", ".join(f"f{k} double" for k in range(width)), make).toArrow().sort_by("doc_id")
    grammar = Grammar(*lexicon)
    grammar.weights, grammar.bias = _fit(np.column_stack([got[f"f{k}"].to_numpy() for k in range(width)]), (got["label"].to_numpy() > 0).astype(float))
    shared.unpersist()
    release(rows)
    return grammar


def toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.3).

    Null text counts as empty, which matches nothing; null and repeated ids are kept; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def make():
        g = shared.value.fresh()

        def work(columns):
            scores = [g.score(t) for t in columns[2]]
            return {"doc_id": columns[0], "held_out": columns[1], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

        return work

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "text")
    return arrow_rows(rows, "doc_id long, held_out boolean, score double, predicted int", make)


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores 0.3 or more; all columns stay.

    Any frame will do, also one of a join, a union or a generator: its rows are numbered once.
    """
    keyed = with_row_key(docs)
    own = keyed.select(F.col(column_of(docs, "doc_id")).alias("doc_id"), F.col(column_of(docs, text_col)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(taught(own, labels))

    def make():
        g = shared.value.fresh()

        def work(columns):
            bad = [i for i, t in enumerate(columns[2]) if g.score(t) >= THRESHOLD]
            return {"gone_file": [columns[0][i] for i in bad], "gone_row": [columns[1][i] for i in bad]}

        return work

    gone = cut(arrow_rows(keyed.select("file_key", "row_key", column_of(docs, text_col)), "gone_file long, gone_row long", make))
    return without_rows(keyed, gone, docs.columns)
