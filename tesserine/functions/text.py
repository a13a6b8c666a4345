"""Text operators as Column functions. Two of them need Python and run as Arrow-batched UDFs; the rest stays in the JVM."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..config import DEFAULT

#: White space as Unicode has it, and the four separators that Python counts too: as a pattern and as characters.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"

#: The kinds of embedded media, and the escapes of SQL dumps.
MEDIA = "File|Image|Media"
SQL_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
#: Common entities, in the order they are replaced; & comes last.
COMMON_ENTITIES = [("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
ARTICLE_URL = "https://en.wikipedia.org/wiki?curid="
#: Patterns that decide what is markup.
REFERENCE = r"(?is)<ref\b[^>]*>.*?</ref>"
TAG = "<[^>]+>"
FURNITURE = rf"(?iU)^{SPACE}*(?:\[\[\s*(?:{MEDIA})\s*:|[!|]|\{{\||\{{\{{|==)"
EXTERNAL_LINK = r"(?U)\[(?:https?|ftp)://[^\s\]]*(?:\s+([^\]]*))?\]"
QUOTE_RUN = "'{2,5}"
STRAY = r"\[\[|\]\]|\{\{|\}\}|\{\||\|\}"
SENTENCE = r"(?sU)^(.*?[.!?])\s"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, however often body names it, and also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind around it."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """All entities of HTML5, named and numeric."""
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(c: Column, common: bool = False) -> Column:
    """Entities decoded. With common only a closed set, in the JVM; else only texts that hold an & go to Python."""
    if common:
        for entity, char in COMMON_ENTITIES:
            c = F.replace(c, F.lit(entity), F.lit(char))
        return c
    return F.coalesce(html_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def drop_references(c: Column) -> Column:
    return F.regexp_replace(c, REFERENCE, " ")


def drop_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, " ")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}*\n{SPACE}*\n{SPACE}*", "\n")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "[ \\t]+", " ")


def strip_lines(c: Column) -> Column:
    return strip(F.array_join(F.transform(F.split(c, LINE_END), strip), "\n"))


def clean_text(c: Column, common_entities: bool = False) -> Column:
    """Entities, references, tags, blank lines, spaces, lines: in this order, so an escaped tag is a tag."""
    c = drop_tags(drop_references(decode_entities(c, common_entities)))
    return strip_lines(collapse_spaces(collapse_blank_lines(c)))


def is_furniture(c: Column) -> Column:
    """Whether a paragraph begins as a media caption, a table, a template or a heading."""
    return c.rlike(FURNITURE)


def _without_spans(text: str, opening: re.Pattern, tokens: re.Pattern, close: str) -> str:
    """text without what stands from a match of opening to the close that balances it, or to the end if none does."""
    kept, at = [], 0
    while m := opening.search(text, at):
        kept.append(text[at : m.start()])
        depth = 0
        for token in tokens.finditer(text, m.start()):
            depth += -1 if token[0] == close else 1
            if depth == 0:
                at = token.end()
                break
        else:
            return "".join(kept)
    return "".join(kept) + text[at:]


_MEDIA = re.compile(rf"\[\[\s*(?:{MEDIA})\s*:", re.I)
_LINK_TOKENS, _TEMPLATE, _TEMPLATE_TOKENS = re.compile(r"\[\[|\]\]"), re.compile(r"\{\{"), re.compile(r"\{\{|\}\}")


@F.pandas_udf(StringType())
def remove_nested(texts: pd.Series) -> pd.Series:
    """Embedded media, then templates, removed with all that is nested in them."""
    return texts.map(lambda t: _without_spans(_without_spans(t, _MEDIA, _LINK_TOKENS, "]]"), _TEMPLATE, _TEMPLATE_TOKENS, "}}"), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def remove_nested_each(texts: pd.Series) -> pd.Series:
    """remove_nested() of every element."""
    one = lambda t: t and _without_spans(_without_spans(t, _MEDIA, _LINK_TOKENS, "]]"), _TEMPLATE, _TEMPLATE_TOKENS, "}}")
    return texts.map(lambda ts: [one(t) for t in ts], na_action="ignore")


def drop_spans_each(cs: Column) -> Column:
    """drop_spans() of every element of an array, which goes to Python only if some element holds an opening token."""
    opens = F.exists(cs, lambda x: F.contains(x, F.lit("[[")) | F.contains(x, F.lit("{{")))
    return F.coalesce(remove_nested_each(F.when(opens, cs)), cs)


def drop_spans(c: Column) -> Column:
    """remove_nested(), with only the texts that hold an opening token going to Python."""
    return F.coalesce(remove_nested(F.when(F.contains(c, F.lit("[[")) | F.contains(c, F.lit("{{")), c)), c)


def unwrap_links(c: Column) -> Column:
    """[[target|display]] to display, [[target]] and [[target|]] to target, the innermost first, until nothing changes.

    A pass unwraps all innermost links at once, so the passes are as many as links nest, and one that changes nothing.
    """
    pairs = ((F.length(c) - F.length(F.replace(c, F.lit("[["), F.lit("")))) / 2).cast("int")
    one = lambda t: F.regexp_replace(t, r"\[\[(?:[^\[\]|]*\|([^\[\]]+)|([^\[\]|]*)\|?)\]\]", "$1$2")
    state = lambda t, done: F.struct(t.alias("t"), done.alias("done"))
    step = lambda s, _: F.when(s["done"], s).otherwise(let(one(s["t"]), lambda t: state(t, t == s["t"])))
    return F.when(pairs > 0, F.aggregate(F.sequence(F.lit(1), pairs), state(c, F.lit(False)), step)["t"]).otherwise(c)


def unwrap_external_links(c: Column) -> Column:
    return F.regexp_replace(c, EXTERNAL_LINK, "$1")


def drop_quote_runs(c: Column) -> Column:
    return F.regexp_replace(c, QUOTE_RUN, "")


def drop_stray_delimiters(c: Column) -> Column:
    return F.regexp_replace(c, STRAY, "")


def strip_markup(c: Column, nested: bool = True) -> Column:
    """The prose of a paragraph. Without nested, spans that nest are taken to be gone already, and no Python runs."""
    c = unwrap_links(drop_spans(c) if nested else c)
    return strip(collapse_spaces(drop_stray_delimiters(drop_quote_runs(unwrap_external_links(c)))))


def clean_paragraph(c: Column, min_chars: int = 0, nested: bool = True) -> Column:
    """Display-ready prose; null for null, blank, furniture, nothing left, or fewer than min_chars code points."""
    if nested:
        # Python is not called from inside a lambda, so the spans are dropped first.
        return _prose_of(c, drop_spans(c), min_chars)
    return _prose_of(c, c, min_chars)


def clean_paragraphs(lines: Column, without_spans: Column, min_chars: int = 0) -> Column:
    """clean_paragraph() of every line of an array, given drop_spans_each() of it; lines that come to nothing are left out."""
    cleaned = F.zip_with(lines, without_spans, lambda c, w: _prose_of(c, w, min_chars))
    return F.filter(cleaned, F.isnotnull)


def _prose_of(c: Column, without_spans: Column, min_chars: int) -> Column:
    prose = let(strip_markup(without_spans, nested=False), lambda p: F.when((p != "") & (F.length(p) >= min_chars), p))
    return F.when(~is_blank(c) & ~is_furniture(c), prose)


def body_lines(c: Column, title: Column) -> Column:
    """The non-empty lines of a cleaned text, without a first one that repeats the title."""

    def without_title(lines: Column) -> Column:
        first = F.coalesce((F.get(lines, F.lit(0)) == strip(title)) & (title != ""), F.lit(False))
        return F.when(first, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)

    return let(F.filter(F.split(c, "\n"), lambda x: x != ""), without_title)


def join_paragraphs(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n\n")


def split_paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines, stripped; none for null or empty text."""
    parts = F.split(F.coalesce(c, F.lit("")), rf"(?U)\n{SPACE}*\n")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def raw_paragraphs(c: Column) -> Column:
    """Paragraphs between newlines with blanks around them kept; those of spaces alone, and null text, give none."""
    return F.filter(F.split(c, "\\n\\s*\\n"), lambda x: F.trim(x) != "")


def first_sentence(c: Column, most: int = 200) -> Column:
    """Up to the first . ! or ? before white space within the first characters, or all of these, stripped."""
    head = F.substring(c, 1, most)
    found = F.regexp_extract(head, SENTENCE, 1)
    return strip(F.when(found != "", found).otherwise(head))


def curid(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "curid=(\\d+)", 1), F.lit("")).try_cast("long")


def result_url(page: Column, url: Column) -> Column:
    return F.coalesce(F.concat(F.lit(ARTICLE_URL), page.cast("string")), url, F.lit(""))


def snippet(c: Column, most: int = DEFAULT.extract.snippet_chars) -> Column:
    """White space collapsed; longer than `most` code points: cut, and ... put behind."""
    flat = strip(F.regexp_replace(c, f"(?U){SPACE}+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("...")))


def sql_unescape(c: Column) -> Column:
    """Backslash escapes of SQL dumps, once from left to right; an escape of any other character is that character."""
    parts = F.regexp_extract_all(c, F.lit(r"\\[^\n]|[^\\]+|\\"), F.lit(0))

    def one(part: Column) -> Column:
        out = F.substring(part, 2, 1)
        for letter, char in SQL_ESCAPES.items():
            out = F.when(F.substring(part, 2, 1) == letter, F.lit(char)).otherwise(out)
        return F.when(F.startswith(part, F.lit("\\")) & (F.length(part) == 2), out).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def enough_words(columns: list[Column], more_than: int = 3) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (word_count(c) > more_than)
    return out


def elapsed(seconds: float) -> str:
    """5s, 1m05s, 1h01m05s."""
    s = int(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}m{s % 60:02d}s" if s < 3600 else f"{s // 3600}h{s % 3600 // 60:02d}m{s % 60:02d}s"
