import html
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserine.functions import text as T


def apply(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
    return [r[1] for r in rows.select("k", f(F.col("c")).alias("out")).orderBy("k").collect()]


def slow_links(t):
    before = None
    while before != t:
        before = t
        t = re.sub(r"\[\[(?:[^\[\]|]*\|([^\[\]]+)|([^\[\]|]*)\|?)\]\]", lambda m: m[1] or m[2] or "", t)
    return t


def slow_prose(t):
    for opening, pair in ((r"(?i)\[\[\s*(?:file|image|media)\s*:", ("[[", "]]")), (r"\{\{", ("{{", "}}"))):
        out = ""
        while m := re.search(opening, t):
            out, rest, depth, at = out + t[: m.start()], t[m.start() :], 0, 0
            while at < len(rest):
                two = rest[at : at + 2]
                depth += (two == pair[0]) - (two == pair[1])
                at += 2 if two in pair else 1
                if depth == 0:
                    break
            if depth:
                t, rest = "", ""
            t = rest[at:]
        t = out + t
    t = slow_links(t)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]*(?:\s+([^\]]*))?\]", lambda m: m[1] or "", t)
    t = re.sub(r"\[\[|\]\]|\{\{|\}\}|\{\||\|\}", "", re.sub("'{2,5}", "", t))
    return re.sub("[ \t]+", " ", t).strip()


CASES = [
    ("[[File:q.png|left|a view of [[Hill|the hill]] at dawn]] Prose after it.", "Prose after it."), ("a {{cite|{{inner}} x}} b", "a b"), ("a [[File:cut off", "a"), ("[[north|]], [[a|b]], [[c]]", "north, b, c"),
    ("[[a|[[b]]]]", "b"), ("[[]]x", "x"), ("'''bold''' ''it''", "bold it"), ("[http://a.b/c d e] [https://x.y]", "d e"), ("]] {| x |} [[", "x"), ("a \t b", "a b"), ("", ""), ("plain", "plain"),
]


def test_strip_markup_cases(spark):
    assert apply(spark, [c for c, _ in CASES], T.strip_markup) == [w for _, w in CASES]


def test_strip_markup_on_random_markup(spark):
    r = random.Random(8)
    parts = ["[[", "]]", "{{", "}}", "|", "File:", "image :", "a", "b c", " ", "'''", "''", "[http://x.y z]", "{|", "|}", "[", "]"]
    some = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(600)]
    assert apply(spark, some, T.strip_markup) == [slow_prose(t) for t in some]


def test_furniture_and_clean_paragraph(spark):
    cases = ["[[File:x.jpg|cap]]", "  | cell", "! head", "{| class", "{{box}}", "== Head ==", "= one =", "a [[File:x]] b", "[[ image : y]]", "prose", "  ", "", None, "[[ ]]", "''''"]
    assert apply(spark, cases, T.is_furniture)[:10] == [True, True, True, True, True, True, False, False, True, False]
    assert apply(spark, cases, T.clean_paragraph) == [None] * 6 + ["= one =", "a b", None, "prose"] + [None] * 5
    assert apply(spark, ["x" * 69, "x" * 70], lambda c: T.clean_paragraph(c, 70)) == [None, "x" * 70]


def test_clean_text(spark):
    raw = "A &lt;br&gt; &amp;amp; b<ref name=x>gone\nhere</ref>c\n \n\n d \t e  \n f\x85g"
    got = apply(spark, [raw, None, "&eacute;&#233;&#xe9; &bogus;"], T.clean_text)
    t = re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<ref\b[^>]*>.*?</ref>", " ", html.unescape(raw)))
    t = re.sub("[ \t]+", " ", re.sub(r"\s*\n\s*\n\s*", "\n", t))
    assert got[0] == "\n".join(x.strip() for x in t.splitlines()).strip()
    assert got[1] is None and got[2] == "ééé &bogus;"


@pytest.mark.parametrize("value", ["", " \t", " x ", "\x1cy\x1f", "a b", "\n z　\x85"])
def test_strip_is_that_of_python(spark, value):
    assert apply(spark, [value], T.strip) == [value.strip()]


def test_paragraphs(spark):
    cases = ["a\n\nb", "a\n \n\n b \nc", "", None, "\n\n", "y \n \nz"]
    assert apply(spark, cases, T.split_paragraphs) == [["a", "b"], ["a", "b \nc"], [], [], [], ["y", "z"]]
    assert apply(spark, ["a \n\n \t\n\nb"], T.raw_paragraphs)[0] == ["a ", "b"]


def test_sentences_snippets_and_ids(spark):
    assert apply(spark, ["One. Two.", "No end", "x" * 300, "Dr. A!", "What?\nYes"], T.first_sentence) == ["One.", "No end", "x" * 200, "Dr.", "What?"]
    assert apply(spark, ["a  b\nc", "w " * 150], T.snippet) == ["a b c", ("w " * 150)[:220].rstrip() + "..."]
    assert apply(spark, ["http://x/?curid=12", "http://x/", None, "curid=" + "9" * 30], T.curid) == [12, None, None, None]
    assert [T.elapsed(s) for s in (5.9, 65, 3665)] == ["5s", "1m05s", "1h01m05s"]


def test_sql_unescape(spark):
    cases = [r"a\'b", r"a\\b", r"a\\\'b", r"tab\tnl\n", r"\q\%", "a\\\nb", "end\\", None]
    assert apply(spark, cases, T.sql_unescape) == ["a'b", "a\\b", "a\\'b", "tab\tnl\n", "q%", "a\\\nb", "end\\", None]


def test_body_lines(spark):
    rows = spark.createDataFrame([("Title\nbody\nTitle", " Title "), ("body", "Title"), ("x\ny", None), ("", "")], "c string, t string")
    assert [r[0] for r in rows.select(T.body_lines(F.col("c"), F.col("t"))).collect()] == [["body", "Title"], ["body"], ["x", "y"], []]
