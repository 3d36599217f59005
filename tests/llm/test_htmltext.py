from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import htmltext, queries

GOLDEN = [
    (None, None),
    ("", ""),
    ("plain &amp; simple &lt;b&gt; &eacute;&nbsp;x", "plain & simple <b> é x"),
    ("a < b and c<d", "a < b and c"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("<div>a</div><div>b <i>c</i>\n d</div>", "a\nb c d"),
    ("x<br>y<br/>z</br>w", "x\ny\nz\nw"),
    ("<h1>T</h1><h2>U<h3>V</h3>text", "T\n\nU\n\nV\n\ntext"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<ul><li><p>one</p><p>two</p></li><li></li></ul>", "- one\n\n  two\n\n-"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<table><tr><th>name<th>n<tr><td>ab<td>1</td><tr><td>c<td>22</table>", "name  n\nab    1\nc     22"),
    ("<table><caption>Cap</caption><td>x</td><td>y</td></table>z", "Cap\nx  y\n\nz"),
    ("<table><tr><td colspan=2>wide one here</td><td>q</td></tr><tr><td>aaaa</td><td>bbbb</td><td>c</td></tr></table>", "wide one here  q\naaaa  bbbb  c"),
    ("<table><tr><td>a<br>b</td><td><table><tr><td>in<td>ner</table></td></tr></table>", "a  in  ner\nb"),
    ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("<script>var x='</p>';</script>a<style>p{}</style>b<!-- c > d -->e", "abe"),
    ("<head><title>T</title></head><body>x", "x"),
    ("<title>T</title>x", "x"),
    ("<head><meta charset=utf-8><p>x", "x"),
    ("a<span hidden>no</span><span style='color:red; display : none'>no<b>no</b></span><b style=\"visibility:hidden\">no</b>z", "az"),
    ("<input type=hidden value=x>a<textarea>b\nc</textarea>", "a\nb\nc"),
    ("<a title='x > y'>l</a><a href=\"unclosed>m</a> n", "lm n"),
    ("<b>x", "x"),
    ("</b></p></td>x</div>", "x"),
    ("a<blockquote>q<p>r</p></blockquote>s", "a\n\n  q\n\n  r\n\ns"),
    ("a<hr>b", "a\n\n---\n\nb"),
    ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
    ("<select><option>x<option>y</select>", "x\ny"),
    ("<![CDATA[x]]>y<?php z ?>w", "yw"),
    ("<script>never closed <p>x", ""),
    ("<td>loose</td><li>item", "loose\n- item"),
]


@pytest.mark.parametrize(("html", "text"), GOLDEN)
def test_golden(html, text):
    assert htmltext.render(html) == text


class Plain(HTMLParser):
    """Visible words in order, without any layout."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.off += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.off -= 1

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "so x=2 holds"),
        ("<math><semantics><mi>y</mi><annotation encoding='t'>\\y</annotation></semantics></math>z", "yz"),
        ("a<svg><title>T</title><desc>D</desc><defs><text>no</text></defs><style>p{}</style><path d='M0'/><text>in</text><text>out <tspan>put</tspan></text></svg>b", "a in out put b"),
        ("<svg><title/><defs/><desc/><g><text>seen</text></g></svg> after <desc>too</desc>", "seen after too"),
        ("<svg style='display:none'><text>no</text></svg><svg/>x", "x"),
    ],
)
def test_formulas_and_diagrams_show_their_text(html, text):
    assert htmltext.render(html) == text


def test_query_keeps_every_visible_word(spark):
    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    rows = queries.QUERIES["op8_layout_aware_html"](spark, path).collect()
    assert len(rows) == len(pages)
    for r in rows:
        plain = Plain()
        plain.feed(pages[r.page_id])
        plain.close()
        want = "".join("".join(plain.words).split())
        got = "".join(w for line in r.text.split("\n") for w in line.removeprefix("- ").split())
        assert got.replace("-", "") == want.replace("-", "") and r.n_chars == len(r.text)


PIECES = ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "</table>", "<td>", "<tr>", "</tr>", "<b>", "</b>", "<div>", "</div>", "<pre>", "</pre>", "<br>", "word", " x ", "\n", "<h1>", "</h2>", "<head>", "<caption>", "<dd>", "</dd>", "<option>", "<span hidden>", "</span>", '<a b="', "'>", "&amp", "<"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_any_soup_renders(html):
    text = htmltext.render(html)
    assert not text.startswith("\n") and not text.endswith("\n") and "  \n" not in text + "\n" or "<pre>" in html


def test_depth_and_length_are_no_limit():
    deep = htmltext.render("<div><ul><li>" * 3000 + "x" + "</li></ul></div>" * 3000)
    assert deep.strip().endswith("x")
    assert len(htmltext.render("<p a='" * 20_000 + "x")) < 200_000
    assert htmltext.render("<table>" + "<tr><td>" + "w" * 5000 + "<td>z" * 1 + "</table>").count(" ") < 10


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "<p>x</p>"), (3, "<p>x</p>"), (None, "y"), (4, "<p>z " * 30_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in htmltext.extract(df).collect()), key=repr)
    assert got == sorted(((i, htmltext.render(h)) for i, h in rows), key=repr)
    assert htmltext.extract(df.where(F.lit(False))).count() == 0
