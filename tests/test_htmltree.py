"""Trees as the HTML standard builds them: implied parts, tables, formatting elements, heads of fragments."""

import random
import time

import pytest

from quire.functions import dom
from quire.operators import extract


def body(html):
    return dom.body_of(dom.parse(html)).inner_html()


def page(html):
    return dom.parse(html).inner_html()


@pytest.mark.parametrize(
    "html, expected",
    [
        ("", "<html><head></head><body></body></html>"),
        ("a", "<html><head></head><body>a</body></html>"),
        (" <p>a", "<html><head></head><body><p>a</p></body></html>"),
        ("<script>x<y</script><style>p{}</style><p>a", "<html><head><script>x<y</script><style>p{}</style></head><body><p>a</p></body></html>"),
        ("<p>a<script>x</script>", "<html><head></head><body><p>a<script>x</script></p></body></html>"),
        ("<title>a &amp; <b></title>c", "<html><head><title>a &amp; &lt;b&gt;</title></head><body>c</body></html>"),
        ("<head></head><meta name=a><body id=x><body id=y class=z>b", '<html><head><meta name="a"></head><body id="x" class="z">b</body></html>'),
        ("<html lang=a><html lang=b id=c>", '<html lang="a" id="c"><head></head><body></body></html>'),
        ("a</body>b</html><i>c", "<html><head></head><body>ab<i>c</i></body></html>"),
        ("<noscript><p>a</noscript>b", "<html><head><noscript><p>a</noscript></head><body>b</body></html>"),
        ("<title>never closed <p>b", "<html><head><title>never closed &lt;p&gt;b</title></head><body></body></html>"),
    ],
)
def test_pages(html, expected):
    assert page(html) == expected


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>1<p>2<div>3</p>4</div>", "<p>1</p><p>2</p><div>3<p></p>4</div>"),
        ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
        ("<li>hello<li>world<ul>how<li>do</ul>you", "<li>hello</li><li>world<ul>how<li>do</li></ul>you</li>"),
        ("<dl><dt>a<dd>b<dt>c</dl>d", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>d"),
        ("a</br>b</p>c", "a<br>b<p></p>c"),
        ("<pre>\na\n</pre>", "<pre>a\n</pre>"),
        ("<image src=a>", '<img src="a">'),
        ("<a id=1 id=2>b</a>", '<a id="1">b</a>'),
        ("<form><form id=x>a</form>b", "<form>a</form>b"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
        ("<select><option>a<option>b<p>c</select>d", "<select><option>a</option><option>bc</option></select>d"),
        ("<textarea><p>a&lt;</textarea>b", "<textarea>&lt;p&gt;a&lt;</textarea>b"),
        ("<ruby>a<rt>b<rt>c</ruby>", "<ruby>a<rt>b</rt><rt>c</rt></ruby>"),
        ("<svg><path/><g>a</g></svg>", "<svg><path></path><g>a</g></svg>"),
        ("<div/>a", "<div>a</div>"),
        ("<td>a</td><tr>b", "ab"),
    ],
)
def test_blocks(html, expected):
    assert body("<body>" + html) == expected


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<font><p>hello<b>cruel</font>world", "<font></font><p><font>hello<b>cruel</b></font><b>world</b></p>"),
        ("<a x>0<b>1<a y>2", '<a x="">0<b>1</b></a><b><a y="">2</a></b>'),
        ("<p><b>a<p>b", "<p><b>a</b></p><p><b>b</b></p>"),
        ("<p><b><b><b><b>a<p>b", "<p><b><b><b><b>a</b></b></b></b></p><p><b><b><b>b</b></b></b></p>"),
        ("<b>a<object>b</b>c</object>d", "<b>a<object>bc</object>d</b>"),
        ("<a href=1><div>a<a href=2>b", '<a href="1"></a><div><a href="1">a</a><a href="2">b</a></div>'),
    ],
)
def test_formatting(html, expected):
    assert body("<body>" + html) == expected


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>d"),
        ("<table><td>a", "<table><tbody><tr><td>a</td></tr></tbody></table>"),
        ("<table><col><caption>a<tr><th>b", "<table><colgroup><col></colgroup><caption>a</caption><tbody><tr><th>b</th></tr></tbody></table>"),
        ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"),
        ("<table> <tr>a<td>b</table>", "a<table> <tbody><tr><td>b</td></tr></tbody></table>"),
        ("<table><table><tr><td>a", "<table></table><table><tbody><tr><td>a</td></tr></tbody></table>"),
        ("<table><tr><td><table><tr><td>a</table>b</table>c", "<table><tbody><tr><td><table><tbody><tr><td>a</td></tr></tbody></table>b</td></tr></tbody></table>c"),
        ("<table><tr><tr><td><td><span><th><span>X</table>", "<table><tbody><tr></tr><tr><td></td><td><span></span></td><th><span>X</span></th></tr></tbody></table>"),
        ("<font><div>hello<table>excite!<b>me!<th><i>please!</tr>", "<font><div>helloexcite!<b>me!</b><table><tbody><tr><th><i>please!</i></th></tr></tbody></table></div></font>"),
        ("<a><table><td><a><table></table><a></tr><a></table><b>X</b>C<a>Y", "<a><a></a><table><tbody><tr><td><a><table></table></a><a></a></td></tr></tbody></table></a><a><b>X</b>C</a><a>Y</a>"),
        ("<table><tr><td>a</td></tr><tfoot><tr><td>b</table>", "<table><tbody><tr><td>a</td></tr></tbody><tfoot><tr><td>b</td></tr></tfoot></table>"),
        ("<table><input type=hidden><input><tr></table>", '<input><table><input type="hidden"><tbody><tr></tr></tbody></table>'),
        ("<p>a<table><tr><td>b</table>c", "<p>a<table><tbody><tr><td>b</td></tr></tbody></table>c</p>"),
        ("<table><tr><td><select><option>a</tr></table>b", "<table><tbody><tr><td><select><option>a</option></select></td></tr></tbody></table>b"),
    ],
)
def test_tables(html, expected):
    assert body("<body>" + html) == expected


def test_doctype_ends_a_p_before_a_table():
    assert body("<!DOCTYPE html><p>a<table></table>b") == "<p>a</p><table></table>b"


def test_rules_see_the_tree():
    html = "<table><tr><td><a href=/1>A</a><tr><td><a href=/2>B</table>"
    assert [e.attrs["href"] for e in dom.select(dom.parse(html), "table > tbody > tr:nth-child(2) > td > a")] == ["/2"]
    assert extract.extract(dom.parse("<p>a"), "html > body > p") == "a"
    # a fragment's leading script goes into the head, so the body's output loses it
    assert extract.remove_selected("<script>x</script><p>a</p><i>b</i>", "i") == "<p>a</p>"


TAGS = "a b i p div span table tr td th tbody thead caption col li ul h1 select option button form nobr object br hr input script title svg html head body".split()


def test_any_tags_give_a_whole_tree():
    """Random tags, open, closed and misnested: no text is lost outside of raw ones, every parent knows its children, and the
    written tree reads as one html with a head and a body."""
    r = random.Random(5)
    for _ in range(3000):
        words, n = [], 0
        for _ in range(r.randint(1, 25)):
            kind, tag = r.random(), r.choice(TAGS)
            if kind < 0.3:
                words.append(f"w{n};")
                n += 1
            else:
                words.append(f"<{'/' if kind < 0.6 else ''}{tag}>")
        html = "".join(words)
        root = dom.parse(html)
        assert [e.name for e in root.elements()] == ["html"], html
        assert [e.name for e in root.elements()[0].elements()] == ["head", "body"], html
        for e in [root, *root.walk()]:
            assert all(c.parent is e for c in e.elements()), html
        if "<script>" not in html and "<title>" not in html:
            assert sorted(x for x in root.text().split(";") if x) == sorted(f"w{k}" for k in range(n)), html


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<p>", "<table>", "<table><tr><td>", "<li>", "<a><div>", "<b><p>", "</p>", "<select>", "<i>a</b>"])
def test_deep_pages_end(piece):
    start = time.monotonic()
    dom.parse(piece * 2000).inner_html()
    assert time.monotonic() - start < 20
