"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a page's language are multiplied: the likelihood of its text under character trigram models,
the language its markup declares, the language its address points to (a country suffix or a path segment), and how
often its host speaks each language. What a declaration or an address is worth, and what a host speaks, is not assumed
but counted: grouped aggregations over all pages sum the text posteriors, for each host, for each domain and over all; a
host with few pages leans on its domain, a domain on everything. A page's own text is taken out of its host's counts.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, pick, release

#: At most so many labelled documents of each language teach the text models, whole texts of any length.
TEACHING_ROWS = 1_000
TABLE = 1 << 14
#: Trigrams overlap, so a text says as much as so many independent ones at most, at this share of their number.
TEMPER, MOST_TRIGRAMS = 0.15, 400
#: How many pages a domain's prior weighs for its host, and all pages for a domain.
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 10.0
#: Pseudo-counts of declared and address languages.
SMOOTH = 1.0
NONE, OTHER = "none", "other"

#: Country suffixes whose sites mostly use one language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}

_OPENING = re.compile(r"(?i)<(script|style|nav|noscript|template)\b|<!--")
_CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "nav", "noscript", "template")} | {"": re.compile("-->")}
_TAG = re.compile(r"(?s)<[^>]*>")
_HEAD_TAG = re.compile(r"(?i)<(html|meta)\b")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})\b")
_META, _CONTENT = re.compile("(?i)content-language"), re.compile(r"(?i)content\s*=\s*[\"']?([a-z]{2,3})\b")
_ADDRESS = re.compile(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?(/[^?#]*)?")


def _without_hidden(page: str) -> str:
    """page with each hidden element, from its opening to the next closing, made a space; one that is never closed stays.

    A closing that is not found once is not looked for again, so unclosed elements cost one search in all.
    """
    kept, at, gone = [], 0, set()
    pos = 0
    while m := _OPENING.search(page, pos):
        name = (m[1] or "").lower()
        end = None if name in gone else _CLOSING[name].search(page, m.end())
        if end is None:
            gone.add(name)
            pos = m.start() + 1
            continue
        kept += [page[at : m.start()], " "]
        at = pos = end.end()
    return "".join(kept) + page[at:]


def visible(page: str | None) -> str:
    """The text of a page: no hidden elements, no tags, entities decoded."""
    line = _without_hidden(page or "")
    last = line.rfind(">") + 1  # no tag ends beyond it
    return html.unescape(_TAG.sub(" ", line[:last]) + line[last:])


def declared(page: str | None) -> str:
    """The language of the first html or meta tag that declares one, or NONE.

    A tag reaches to the next >, which all tags opened before it share: if the first html tag before a > declares nothing,
    no later one does, and so for meta tags. Each stretch is searched once.
    """
    page = page or ""
    pos = 0
    while m := _HEAD_TAG.search(page, pos):
        end = page.find(">", m.start())
        end = len(page) if end < 0 else end
        first = {m[1].lower(): m.start()}
        other = re.compile("(?i)<meta\\b" if "html" in first else "(?i)<html\\b").search(page, m.end(), end)
        if other:
            first["meta" if "html" in first else "html"] = other.start()
        found = []
        if "html" in first and (lang := _LANG.search(page, first["html"] + 5, end)):
            found.append((first["html"], lang[1]))
        if "meta" in first and (named := _META.search(page, first["meta"] + 5, end)):
            for content in _CONTENT.finditer(page, named.end(), end):
                last = content[1]
            if _CONTENT.search(page, named.end(), end):
                found.append((first["meta"], last))
        if found:
            return min(found)[1].lower()
        pos = end
    return NONE


def _hashes(text: str) -> np.ndarray:
    """Trigrams of the lower-cased letters of a text, words apart, hashed to TABLE cells."""
    line = re.sub(r"[\W\d_]+", " ", text.lower())
    points = np.frombuffer(f" {line.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(TABLE)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # languages x TABLE

    def log_likelihood(self, text: str) -> list[float]:
        """Tempered log likelihoods, the best one 0; no letters: all 0."""
        cells = _hashes(text)
        if not len(cells):
            return [0.0] * len(self.languages)
        total = self.logs[:, cells].mean(axis=1) * min(len(cells), MOST_TRIGRAMS) * TEMPER
        return (total - total.max()).tolist()


def _model(total: dict[str, np.ndarray]) -> TextModel:
    languages = sorted(total) or ["und"]
    counts = np.array([total.get(lang, np.zeros(TABLE)) + 0.5 for lang in languages])
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def learn(rows: list[tuple[str, str]]) -> TextModel:
    """Trigram models from (text, language)."""
    total: dict[str, np.ndarray] = {}
    for text, lang in rows:
        total[lang] = total.get(lang, 0) + np.bincount(_hashes(text), minlength=TABLE)
    return _model(total)


def taught(docs: DataFrame) -> TextModel:
    """From documents (text, lang) of every language, at most TEACHING_ROWS of each, the first by a hash of doc_id.

    Rows without doc_id, lang or text teach nothing; a repeated row teaches once for each language it names, and counts
    among its language's rows as often as it stands there. There is no bound on languages or on the length of texts: only
    TABLE counts for each language come to the driver.
    """
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang").where("doc_id is not null and lang is not null and text is not null")
    # A language with many documents is thinned by the hash before its rows meet: about twice as many as may teach are left.
    size = cut(rows.groupBy(F.col("lang").alias("size_lang")).agg(F.count("*").alias("n")))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thin = rows.select("doc_id", "lang").join(size, F.col("lang") == F.col("size_lang")).where(at * F.col("n") < 2 * TEACHING_ROWS)
    first = Window.partitionBy("lang").orderBy(at, "doc_id")
    ids = thin.select("doc_id", "lang").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= TEACHING_ROWS)
    some = cut(ids.select(F.col("doc_id").alias("of_id"), F.col("lang").alias("of_lang")))
    found = cut(rows.join(some, (F.col("doc_id") == F.col("of_id")) & (F.col("lang") == F.col("of_lang"))).dropDuplicates(["doc_id", "lang"]).select("lang", "text"))
    release(some, size)
    model = _counted(found)
    release(found)
    return model


def _counted(found: DataFrame) -> TextModel:
    """learn() of rows (lang, text), with the trigrams counted where the texts are: only counts come to the driver."""

    def make():
        def work(columns):
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(*columns):
                sums[lang] = sums.get(lang, 0) + np.bincount(_hashes(text), minlength=TABLE)
            cells = [np.flatnonzero(x) for x in sums.values()]
            out = {"lang": [lang for lang, at in zip(sums, cells) for _ in at], "cell": [], "n": []}
            for x, at in zip(sums.values(), cells):
                out["cell"] += at.tolist()
                out["n"] += x[at].tolist()
            return out

        return work

    # A language none of whose texts has letters is one all the same. At most TABLE cells a language come to the driver.
    total = {r["lang"]: np.zeros(TABLE) for r in found.select("lang").distinct().collect()}
    cells = arrow_rows(found, "lang string, cell int, n long", make).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    for lang, cell, n in zip(cells["lang"].to_pylist(), cells["cell"].to_pylist(), cells["n"].to_pylist()):
        total[lang][cell] = n
    return _model(total)


def _address(url: str | None, languages: list[str]) -> tuple[str, str, str]:
    """(host, domain, language that the address points to)."""
    m = _ADDRESS.match(url or "")
    host = (m[1] if m else "").lower().strip(".")
    labels = host.split(".")
    lang = SUFFIX_LANGUAGE.get(labels[-1], NONE)
    first = ((m[2] or "") if m else "").strip("/").split("/")[0].lower().split("-")[0]
    if first in languages:
        lang = first
    return host, ".".join(labels[-2:]), lang if lang in languages or lang == NONE else OTHER


def _logsumexp(xs: list[Column]) -> Column:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    total = F.lit(0.0)
    for x in xs:
        total = total + F.exp(x - top)
    return top + F.log(total)


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, lang, confidence, text_lang, declared_lang, address_lang, host.

    Null html counts as empty, which says nothing; a null or odd url has the empty host, shared by all such pages; null
    and repeated ids are kept; an empty table gives an empty result. declared_lang and address_lang are a language, other
    or none. Ties go to the first language in alphabetical order.
    """
    langs = model.languages
    shared = pages.sparkSession.sparkContext.broadcast(model)
    n = len(langs)

    def make():
        held = shared.value

        def work(columns):
            keys, urls, raw = columns
            where = [_address(u, langs) for u in urls]
            said = [declared(h) for h in raw]
            logs = [held.log_likelihood(visible(h)) for h in raw]
            got = {"page_id": keys, "host": [w[0] for w in where], "domain": [w[1] for w in where], "address_lang": [w[2] for w in where]}
            got["declared_lang"] = [s if s in langs or s == NONE else OTHER for s in said]
            return got | {f"t{i}": [x[i] for x in logs] for i in range(n)}

        return work

    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    schema = "page_id long, host string, domain string, address_lang string, declared_lang string, " + ", ".join(f"t{i} double" for i in range(n))
    read = arrow_rows(rows, schema, make)
    whole = _logsumexp([F.col(f"t{i}") for i in range(n)])
    read = cut(read.withColumns({f"p{i}": F.exp(F.col(f"t{i}") - whole) for i in range(n)}))

    sums = lambda: [F.sum(f"p{i}").alias(f"s{i}") for i in range(n)]
    # n sums each: one row over all, and one for each of the n + 2 things that a page can declare or point to.
    overall = read.agg(*sums()).first()
    every = np.array([overall[f"s{i}"] or 0.0 for i in range(n)]) + SMOOTH
    every = every / every.sum()

    def worth(column: str) -> Column:
        """log P(value | language) for the value in a column, as an array over languages; NONE says nothing."""
        table = {r[column]: np.array([r[f"s{i}"] for i in range(n)]) for r in read.groupBy(column).agg(*sums()).collect()}
        values = [v for v in [*langs, OTHER] if v != NONE]
        counts = np.array([table.get(v, np.zeros(n)) for v in values]) + SMOOTH
        logs = np.log(counts / counts.sum(axis=0))
        out = F.lit(None).cast("array<double>")
        for v, row in zip(values, logs):
            out = F.when(F.col(column) == v, F.array(*[F.lit(float(x)) for x in row])).otherwise(out)
        return F.coalesce(out, F.array(*[F.lit(0.0)] * n))

    hosts = read.groupBy("host", "domain").agg(*sums(), F.count("*").alias("n_host"))
    domains = hosts.groupBy(F.col("domain").alias("of_domain")).agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(n)], F.sum("n_host").alias("n_domain"))
    priors = hosts.join(domains, F.col("domain") == F.col("of_domain")).select(F.col("host").alias("of_host"), F.col("domain").alias("with_domain"), *[f"s{i}" for i in range(n)], *[f"d{i}" for i in range(n)], "n_host", "n_domain")
    met = read.join(cut(priors), (F.col("host") == F.col("of_host")) & (F.col("domain") == F.col("with_domain")))
    met = met.withColumns({"w_declared": worth("declared_lang"), "w_address": worth("address_lang")})
    scores = []
    for i in range(n):
        # without the page itself
        of_domain = (F.greatest(F.col(f"d{i}") - F.col(f"p{i}"), F.lit(0.0)) + DOMAIN_WEIGHT * float(every[i])) / (F.col("n_domain") - 1 + DOMAIN_WEIGHT)
        of_host = (F.greatest(F.col(f"s{i}") - F.col(f"p{i}"), F.lit(0.0)) + HOST_WEIGHT * of_domain) / (F.col("n_host") - 1 + HOST_WEIGHT)
        scores.append(F.col(f"t{i}") + F.log(of_host) + F.col("w_declared")[i] + F.col("w_address")[i])
    met = met.withColumns({f"z{i}": s for i, s in enumerate(scores)})
    z = [F.col(f"z{i}") for i in range(n)]
    total = _logsumexp(z)

    def best(xs: list[Column]) -> Column:
        top = F.greatest(*xs) if n > 1 else xs[0]
        out = F.lit(langs[-1])
        for lang, x in list(zip(langs, xs))[-2::-1]:
            out = F.when(x == top, lang).otherwise(out)
        return out

    top = F.greatest(*z) if n > 1 else z[0]
    return met.select("page_id", best(z).alias("lang"), F.round(F.exp(top - total), 6).alias("confidence"), best([F.col(f"t{i}") for i in range(n)]).alias("text_lang"), "declared_lang", "address_lang", "host")
