"""The batch kernels and column expressions against the standard library's parsers, one text at a time."""

import difflib
import html
import random
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import markup
from tallyloom.functions import similarity as S


def by_parts(a, b):
    return 0.0 if a is None or b is None else round(difflib.SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio(), 3)


_TEXT = st.one_of(st.none(), st.text("ab ", max_size=12), st.text(max_size=20), st.text("abcdefgh é😀", max_size=40))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(_TEXT, _TEXT), max_size=12))
def test_ratios_of_a_batch(pairs):
    assert S.sequence_ratios([a for a, _ in pairs], [b for _, b in pairs]) == [by_parts(a, b) for a, b in pairs]


def test_ratios_of_long_texts_pass_over_frequent_characters():
    draw, pairs = random.Random(4), []
    for signs in ("ab", "abc d", "abcdefghijklmnopqrstuvwxyz0123456789 éèêôöü"):
        for n in (198, 199, 200, 201, 640):
            b = "".join(draw.choice(signs) for _ in range(n))
            pairs += [(b[: draw.randrange(n)] + "".join(draw.choice(signs) for _ in range(40)) + b[-90:], b), (b[::-1], b), (b, b), ("", b)]
    assert S.sequence_ratios(*zip(*pairs, strict=True)) == [by_parts(a, b) for a, b in pairs]


def test_ratios_are_one_by_one_what_they_are_together(monkeypatch):
    draw = random.Random(5)
    pairs = [("".join(draw.choice("abc ") for _ in range(draw.randrange(40))), "".join(draw.choice("abc ") for _ in range(draw.randrange(40)))) for _ in range(200)]
    whole = S.sequence_ratios(*zip(*pairs, strict=True))
    monkeypatch.setattr(S, "SHEET", 50)
    assert S.sequence_ratios(*zip(*pairs, strict=True)) == whole == [S.sequence_ratio(a, b) for a, b in pairs]
    assert S.sequence_ratios([], []) == []


class Parsed(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.body, self.inside, self.hidden = [], None, False, 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag == "body" and self.body is None:
            self.body, self.inside = [], True

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.inside = self.inside and tag != "body"

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.inside:
                self.body.append(data)


def parsed(page):
    p = Parsed()
    p.feed(page or "")
    p.close()
    return " ".join(" ".join(p.parts if p.body is None else p.body).split())


_PIECES = ["<p>", "</p>", "<a href='x>y'>", '<img alt="a > b" src=x/>', "<br/>", "<b class=z>", "</b>", "<!-- c <b> -->", "<script>if (a<b) '</p>'</script>", "<STYLE>p{}</STYLE>", "word", " two words\n", "&amp;", "&lt;b&gt;", "&eacute;", "&ampx", "&notit;",
           "&unknown;", "&#65;", "&#x41;", "&#150;", "&#0;", "&#xD800;", "&#99999999999;", "&#1;", "&AMP", "&ngE;", "&nbsp;", "a < b", "&", "é😀", "1 &lt 2"]


@pytest.fixture(scope="module")
def pages():
    draw = random.Random(6)
    flat = ["".join(draw.choice(_PIECES) for _ in range(draw.randrange(1, 9))) for _ in range(400)]
    whole = [f"<!DOCTYPE html><html><head><title>{'T' * (k % 3)}</title></head><body id={k}>{p}</body>{p if k % 2 else ''}</html>" for k, p in enumerate(flat[:150])]
    return flat + whole + [None, "", "<", "<p", "</p", "<body>never closed", "<body", "x<!-- open", "x<script>open", "no tags", "<p title='open>text", "x" * 300_000 + "<b>" * 20_000, "<a b=" * 3000]


def test_visible_text_of_pages(spark, pages):
    got = {r["k"]: r["t"] for r in spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", markup.visible_text(F.col("html")).alias("t")).collect()}
    cut = {"<p", "</p", "<body", "x<!-- open", "x<script>open", "<p title='open>text"}
    wrong = [(p, got[k], parsed(p)) for k, p in enumerate(pages) if p not in cut and len(p or "") < 10_000 and got[k] != parsed(p)]
    assert wrong == []
    assert {p: got[k] for k, p in enumerate(pages) if p in cut} == {"<p": "", "</p": "", "<body": "", "x<!-- open": "x", "x<script>open": "x", "<p title='open>text": ""}
    assert got[len(pages) - 2] == "x" * 300_000 and got[len(pages) - 1] == ""


def test_references(spark):
    names = [f"&{n}" for n in html.entities.html5] + [f"&#{k};" for k in (*range(300), 0xD7FF, 0xE000, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000)] + ["&#x1F600", "&#X00000041;", "&bogus;", "&", "&;"]
    got = {r["e"]: r["c"] for r in spark.createDataFrame([(e,) for e in names], "e string").select("e", markup.unescaped(F.col("e")).alias("c")).collect()}
    assert {e: got[e] for e in names} == {e: html.unescape(e) for e in names}
