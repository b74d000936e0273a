import re
import time

import pytest

from lathe.llm import htmltext
from lathe.llm.common import table

CASES = {
    "<p>one<p>two": "one\n\ntwo",
    "a <b>b</b> c<br>d": "a b c\nd",
    "<div>x</div><div>y</div>": "x\ny",
    "<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>": "- a\n- b\n\n  1. x\n  2. y\n- c",
    "<ol start=9><li>i<li>j</ol>": "9. i\n10. j",
    "<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>Fig<td>12</table>": "Name   Qty\nApple  3\nFig    12",
    "<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>": "wide  z\na  b  c",
    "<p hidden>no</p><p style='display: none'>no</p>yes<script>var a='</p>';</script>": "yes",
    "<style>.gone{display:none} #x{visibility:hidden}</style><p class='a gone'>no<p id=x>no<p class=a>yes": "yes",
    "<head><title>t</title></head><body>b": "b",
    "<pre>\n a  b\n  c</pre>": " a  b\n  c",
    "&lt;b&gt; &amp; &copy;&nbsp;x": "<b> & ©\xa0x",
    "<!-- no --><!DOCTYPE html>x<!-- open": "x",
    "<textarea> a &amp; b </textarea>": "a & b",
    "x < y and y > z": "x < y and y > z",
    "<a href='>'>q</a>": "q",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<p>a</div>b</p>c": "ab\n\nc",
    "": "",
    # formulas and drawings
    "<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>": "x=1/2",
    "<svg><title>t</title><text>label</text> no <g><text>two</text></g></svg>after": "label\ntwo\nafter",
    # spans, long and many-lined cells
    "<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>": "A  b\n   c\nd  e",
    "<table><tr><td rowspan=2>A<p>B<p>C<td>b<tr><td>c</table>": "A  b\n   c\nB\n\nC",
    "<table><tr><td colspan=1000>big<tr><td>a<td>b</table>": "big\na  b",
    "<table><tr><td>" + "x" * 45 + "<td>b<tr><td>a<td>c</table>": "x" * 45 + "  b\na" + " " * 46 + "c",
    "<table><tr><td>" + "word " * 20 + "<td>b</table>": "word " * 15 + "word  b\nword word word word",
    "<table><tr><td><p>one<p>two<ul><li>x<li>y</ul></table>": "one\n\ntwo\n\n- x\n- y",
    "<table><tr><td><ul><li>x<li>y</ul><td><pre>p\n q</pre></table>": "- x  p\n- y   q",
    "<table><tr><td><table><tr><td>i<td>j<tr><td>kk<td>l</table><td>out</table>": "i   j  out\nkk  l",
    "<table><caption>Cap</caption><tr><td>1</table>": "Cap\n1",
    # style sheets
    "<style>@media print { .a{color:red} .nav{display:none} } .gone{display:none}</style><p class=nav>yes<p class=gone>no": "yes",
    "<style>@media screen and (max-width: 600px) {.a{display:none}} @media (min-width:900px){.b{display:none}} @font-face{x:y}</style><p class=a>yes<p class=b>no": "yes",
    "<style>/* .c{display:none} */ @import 'x'; p.d, #e {visibility:hidden}</style><p class=c>c<p class=d>no</p><i class=d>i</i><p id=e>no": "c\n\ni",
}


@pytest.mark.parametrize("source", CASES)
def test_layout(source):
    assert htmltext.render(source) == CASES[source]


def test_all_visible_words_survive_in_order(spark, small):
    """Brute force for pages without hidden parts: strip tags, compare words."""
    import html

    for r in table(spark, small, "pages").limit(80).collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", r.html)
        want = html.unescape(re.sub(r"<[^<>]*>", " ", body)).split()
        got = [w for w in htmltext.render(r.html).split() if w not in ("-",)]
        assert got == [w for w in want if w not in ("-",)], r.page_id


@pytest.mark.parametrize("depth", [10, 160, 20_000])
def test_hidden_text_stays_hidden_at_any_depth(depth):
    assert htmltext.render("<div>" * depth + "<p hidden>SECRET</p>open") == "open"
    assert htmltext.render("<div hidden>" + "<div>" * depth + "SECRET" + "</div>" * depth + "</div>open") == "open"


def test_a_page_laid_out_in_a_table():
    source = "<table><tr><td>Title of the page<tr><td><h1>Head</h1><p>Text.<ul><li>a<li>b</ul><table><tr><td>k<td>v</table></table>"
    assert htmltext.render(source) == "Title of the page\nHead\n\nText.\n\n- a\n- b\n\nk  v"


def reading_order(source):
    """Visible words by the standard library's parser, for markup that is well formed and hides by attribute only."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            if self.hidden or "hidden" in dict(attrs) or tag in htmltext.HIDDEN:
                self.hidden += 1

        def handle_endtag(self, tag):
            self.hidden -= bool(self.hidden)

        def handle_data(self, data):
            if not self.hidden:
                self.words += data.split()

    reader = Reader()
    reader.feed(source)
    return reader.words


@pytest.mark.parametrize("seed", range(25))
def test_random_trees_against_another_parser(seed):
    """Every visible word once and no hidden one; in order where no cells stand side by side."""
    import random

    rng = random.Random(seed)
    count = iter(range(10**6))

    def tree(depth, cells):
        tag = rng.choice(["div", "section", "b", "span", "ul", "blockquote", "table" if cells else "div"])
        inner = [f"w{next(count)} " if rng.random() < 0.5 or depth == 0 else tree(depth - 1, cells) for _ in range(rng.randint(1, 4))]
        if tag == "ul":
            inner = [f"<li>{x}</li>" for x in inner]
        if tag == "table":
            inner = [f"<tr><td{rng.choice(['', ' rowspan=2', ' colspan=2', ' hidden'])}>{x}</td><td>w{next(count)}</td></tr>" for x in inner]
        return f"<{tag}{rng.choice([' hidden', '', '', '', ''])}>{''.join(inner)}</{tag}>"

    for cells in (False, True):
        source = "<div>" + "".join(tree(4, cells) for _ in range(5)) + "</div>"
        got = [w for w in htmltext.render(source).split() if w != "-"]
        want = reading_order(source)
        assert (sorted(got) == sorted(want)) if cells else got == want


@pytest.mark.parametrize("piece", ["<table><td>x<td>", "<blockquote>x", "<ul><li>y", "<td rowspan=9>x", "<style>a{", "<div>", "<a ", "<a '", "<!--", "<table><td>", "<li>", "</p>", "<p>", "&", "<", "<ul><li>", "<style>", "<b><p>"])
def test_broken_markup_is_linear(piece):
    began = time.time()
    assert isinstance(htmltext.render(piece * 20_000 + "end"), str)
    assert time.time() - began < 10


def test_odd_pages(spark):
    rows = [(None, "u", "<p>x"), (1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "w " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "'z' as HTML")
    got = sorted(((r.page_id, r.text) for r in htmltext.rendered(pages).collect()), key=str)
    assert got == sorted([(None, "x"), (1, None), (2, ""), (2, ""), (3, ("w " * 300_000).strip())], key=str)
    assert htmltext.rendered(pages.where("false")).count() == 0
