"""Secret scans: a trigram inverted index picks candidates, the rules' regular expressions verify them. All in the JVM.

A Boolean trigram query is derived from each rule's expression: the trigrams that every match must hold, as alternatives
of sets. The index holds, for each trigram of any query, the texts (by hash) that contain it; the postings of a set are
intersected, and only the texts left are verified. A rule whose expression has no mandatory trigram scans every text.
Trigrams are taken from lower-cased text, so a query never misses a match in either case.
"""

from __future__ import annotations

import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from re._constants import BRANCH, IN, LITERAL, MAX_REPEAT, MIN_REPEAT, RANGE, SUBPATTERN

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, cut, pick


@dataclass(frozen=True)
class Rule:
    """pattern has one group or none; a match counts if the group, or all of it, has at least `least` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = True


#: The base rules in the order of their kinds, then those that the method adds.
RULES = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, base=False),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, base=False),
    # The first part is bounded: without that every eyJ of a run would be read to the run's end.
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{1,997}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1, base=False),
)

Sets = frozenset  # alternatives: a frozenset of frozensets of trigrams; one that holds an empty set says nothing
ANY: Sets = frozenset([frozenset()])
MOST = 64


def _least(sets: Sets) -> Sets:
    """Without alternatives that ask for more than another one does."""
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _both(a: Sets, b: Sets) -> Sets:
    got = _least(frozenset(x | y for x in a for y in b))
    return got if len(got) <= MOST else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Sets:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(items) -> tuple[set[str] | None, Sets]:
    """(all strings that can match, or None; the query). Literals are lower-cased."""
    run: set[str] = {""}
    query, whole = ANY, True
    for op, arg in items:
        exact: set[str] | None = None
        sub = ANY
        if op is LITERAL:
            exact = {chr(arg).lower()}
        elif op is IN and all(k is LITERAL or k is RANGE and v[1] - v[0] < 8 for k, v in arg):
            exact = {chr(c).lower() for k, v in arg for c in ([v] if k is LITERAL else range(v[0], v[1] + 1))}
        elif op is SUBPATTERN:
            exact, sub = _walk(arg[3])
        elif op is BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*[e for e, _ in parts])
            else:
                sub = _least(frozenset().union(*[q if e is None else _of_strings(e) for e, q in parts]))
        elif op in (MAX_REPEAT, MIN_REPEAT):
            low, high, inner = arg
            e, q = _walk(inner)
            if e is not None and (low, high) in ((0, 1), (1, 1)):
                exact = e | ({""} if low == 0 else set())
            elif low:
                sub = q if e is None else _of_strings(e)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        query = _both(query, _both(_of_strings(run), sub if exact is None else _of_strings(exact)))
        run, whole = {""}, False
    return (run, ANY) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Sets:
    """The alternatives of mandatory trigrams of a regular expression; ANY if there is none."""
    exact, query = _walk(list(parser.parse(pattern)))
    return query if exact is None else _of_strings(exact)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _fold(items: Column, start: Column, chunk: Callable[[Column, Column], Column]) -> Column:
    """A fold over an array by chunks of about the square root of its length: chunk(state, some items) is the next state.

    What a state gathers is copied at every step; so n items cost n * sqrt(n) copies and not n * n.
    """
    def over(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        return _let(width, lambda w: F.aggregate(F.sequence(F.lit(0), F.ceil(F.size(xs) / w).cast("int")), start, lambda s, k: _let(F.slice(xs, k * w + 1, w), lambda some: F.when(F.size(some) > 0, chunk(s, some)).otherwise(s))))

    return _let(items, over)


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, n>> of the matches that count, leftmost first, without overlap; code points, end exclusive.

    What stands between matches gives their places: split() keeps the gaps, and gaps and matches alternate.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else found
    none = F.array().cast("array<struct<start:int,end:int,n:int>>")
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), sizes.alias("part"))
    span = lambda at, x: F.array(F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["hit"]).alias("end"), x["part"].alias("n")))
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
        F.when(F.coalesce(x["part"] >= rule.least, F.lit(False)), F.concat(s["out"], span(s["at"], x))).otherwise(s["out"]).alias("out"),
    )
    within = lambda s, some: F.aggregate(some, F.struct(s["at"].alias("at"), none.alias("out")), step)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,n:int>>>").alias("outs"))
    chunk = lambda s, some: _let(within(s, some), lambda r: F.struct(r["at"].alias("at"), F.concat(s["outs"], F.array(r["out"])).alias("outs")))
    return F.flatten(_fold(parts, start, chunk)["outs"])


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(hash, rule): the texts (columns hash, text) that hold some alternative of a rule's trigrams, from the inverted index."""
    queries = [(k, n, sorted(s)) for k, r in enumerate(rules) for n, s in enumerate(sorted(trigram_query(r.pattern), key=sorted)) if trigram_query(r.pattern) != ANY]
    grams = sorted({g for *_, s in queries for g in s})
    spark = texts.sparkSession
    low = F.lower("text")
    held = texts.select("hash", low.alias("low"))
    postings = held.select("hash", F.explode(F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), k) for k, g in enumerate(grams)]), F.isnotnull)).alias("gram")).distinct()
    members = [(grams.index(g), k, n, len(s)) for k, n, s in queries for g in s]
    # The queries of the rules, whose number is fixed.
    wanted = F.broadcast(spark.createDataFrame(members, "of_gram int, rule int, alternative int, size int"))
    met = postings.join(wanted, F.col("gram") == F.col("of_gram")).groupBy("hash", "rule", "alternative").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return met.where("n = size").select("hash", "rule").distinct()


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs as columns c0, c1, ... with `spans`: array<struct<start, kind (number), end>>, sorted so.

    Null text counts as empty and has none. Rows are kept as they are, repeated ones and null ids too. Matches of
    different rules may overlap; those of one rule do not.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(column_of(docs, text_col)), F.lit(""))
    texts = plain.select(F.xxhash64(text).alias("hash"), text.alias("text"))
    found = cut(candidates(texts, rules).groupBy("hash").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules")))
    flagged = plain.withColumn("text_hash", F.xxhash64(text)).join(found.withColumnRenamed("hash", "of_hash"), F.col("text_hash") == F.col("of_hash"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    every = []
    for k, rule in enumerate(rules):
        spans = _of_kind(_spans(text, rule), k)
        if trigram_query(rule.pattern) != ANY:
            spans = F.when(F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << k)) > 0, spans).otherwise(none)
        else:
            spans = F.when(text.rlike(rule.pattern), spans).otherwise(none)
        every.append(spans)
    return flagged.select(*plain.columns, F.array_sort(F.concat(*every)).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def secret_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (see scan)."""
    own = pick(docs, doc_id=id_col, text=text_col)
    rows = scan(own, "text", rules)
    base = [k for k, r in enumerate(rules) if r.base]
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{rules[k].kind}")
    of_base = F.filter("spans", lambda x: x["kind"].isin(base))
    return rows.select(F.col("c0").cast("long").alias("doc_id"), *[count(k) for k in base], F.sha2(_joined(of_base, rules), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by <SECRET>; spans that touch or overlap become one. size_col follows changed texts."""
    rows = scan(docs, text_col, rules)
    at, text = column_of(docs, text_col), F.col(column_of(docs, text_col))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def chunk(s: Column, some: Column) -> Column:
        """The next spans, cut out of the stretch of text that they reach over and not of the text from its beginning."""
        base = s["at"]
        end = F.greatest(base, F.array_max(F.transform(some, lambda x: x["end"])))

        def within(stretch: Column) -> Column:
            step = lambda r, x: (
                F.when(x["end"] <= r["at"], r)
                .when((x["start"] < r["at"]) | ((x["start"] == r["at"]) & (r["at"] > 0)), F.struct(x["end"].alias("at"), r["out"].alias("out")))
                .otherwise(F.struct(x["end"].alias("at"), F.concat(r["out"], F.substring(stretch, r["at"] - base + 1, x["start"] - r["at"]), F.lit("<SECRET>")).alias("out")))
            )
            return F.aggregate(some, F.struct(base.alias("at"), F.lit("").alias("out")), step)

        return _let(F.substring(text, base + 1, end - base), lambda x: _let(within(x), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], r["out"]).alias("out"))))

    walked = _fold(F.col("spans"), start, chunk)
    new = _let(walked, lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text))))
    out = rows.withColumn(at, F.when(F.size("spans") > 0, new).otherwise(text))
    if size_col in docs.columns:
        n = column_of(docs, size_col)
        out = out.withColumn(n, F.when(F.size("spans") > 0, F.length(F.col(at))).otherwise(F.col(n)).cast(docs.schema[size_col].dataType))
    return out.drop("spans").toDF(*docs.columns)
