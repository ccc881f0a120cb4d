import pytest
from pyspark.sql import functions as F

from prospectrum.sources import directories as d
from prospectrum.sources.elements import Page, balanced, balanced_after, cards, filled, first


def texts(html, selector):
    p = Page(html)
    return [p.text_of(e) for e in p.select(selector)]


@pytest.mark.parametrize(
    ("html", "selector", "want"),
    [
        ("<div class='a'>x<div>y</div>z</div>w", "div.a", ["xyz"]),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "li", ["one", "twoin", "in", "three"]),
        ("<ul><li>a<ul><li>b</li></ul>c</li><li>d</li></ul>", "ul li li", ["b"]),
        ("<p>a<p>b<div>c</div>d", "p", ["a", "b"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", "td", ["1", "2", "3"]),
        ("<b>x</i></b> y<br>z</span>", "b", ["x"]),
        ("<div>open <span>and never closed", "div", ["open and never closed"]),
        ("<a href='/company/1/x'>k</a><a href='/b'>l</a>", 'a[href*="/company/"]', ["k"]),
        ("<i id=n class='c d'>1</i><i class=c>2</i>", "i.c.d, #n, i[class=\"c\"]", ["1", "2"]),
        ("<div class='x y-z'>1</div><div class='y'>2</div>", ".y", ["2"]),
        ("<p>a &amp; b &eacute; &#8211;</p>", "p", ["a & b é –"]),
        ("<script>if (a < b) { '<p>no</p>' }</script><p>yes", "p", ["yes"]),
        ("", "p", []),
        ("<ul><li>a</ul></li><li>b", "ul li", ["a"]),
    ],
)
def test_tree(html, selector, want):
    assert texts(html, selector) == want


def test_selector_errors():
    with pytest.raises(ValueError, match="not a selector"):
        list(Page("<p>").select("p > a"))


def test_cards_with_nested_fields(spark):
    page = "<div class='card' data-n='A'><div class='in'>x<div>y</div></div><a href='/a?b=1&amp;c'>l</a><div class='card' data-n='B'></div></div><div class='card'><div class='in'>z"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "no card"), (4, "")], "ord long, html string")
    got = cards(pages, "div.card", 100, {"n": ("", "data-n"), "t": (".in", "text"), "h": ("a", "href")}).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(101, ["A"], ["xy"], ["/a?b=1&c"]), (102, ["B"], [], []), (103, [], ["z"], [])]
    one = cards(pages, "div.card", 100, {"n": ("", "data-n"), "t": (".in", "text")}).where("ord = 103").select(first("n").alias("n"), filled("t").alias("t")).first()
    assert (one.n, one.t) == ("", "z")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('x {"a": {"b": 1}} {"c": 2}', '{"a": {"b": 1}}'),
        ('{"a": "} \\" {", "b": {}}; more }', '{"a": "} \\" {", "b": {}}'),
        ('{"a": {"b": 1}', None),
        ('{"a": "never closed }', None),
        ("} } none", None),
        ("say \"hi\" {1}", "{1}"),
        ("", None),
        (None, None),
    ],
)
def test_balanced(text, want):
    assert balanced(text) == want


def test_balanced_after(spark):
    rows = ['<script>a = {"no": 1}; window.D = {"x": "}"}; window.E = {};</script>', "window.D {}", "nothing", None, 'window.D = {"cut": {"off": 1}']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, html string").select("i", balanced_after(F.col("html"), "window.D").alias("j")).orderBy("i").collect()
    assert [r.j for r in got] == ['{"x": "}"}', None, None, None, None]
