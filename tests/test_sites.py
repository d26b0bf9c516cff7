"""Pages of many sources read by their own rules: rows, rejected rows, tables of contents, chapters."""

import json

from quire.operators import extract, projections, sites, toc
from quire.functions import dom
from quire.sources import rules as R

BIG = 9007199254740993

RULES = [
    {
        "url": "https://a.x/", "name": "a",
        "search": {"url": "https://a.x/s?q=%s", "result": "li", "bookName": "a@href", "author": "i"},
        "book": {"url": "https://a.x/book/(\\d+)@js:r", "bookName": "h1", "author": "h2"},
        "toc": {"url": "https://a.x/toc/%s/1", "item": "ol a", "nextPage": "select option", "isDesc": True},
        "chapter": {"content": "#c", "filterTag": "h3", "nextPage": "a.n", "nextPageInJs": "script#s@js:match1(\"next='([^']*)'\")", "nextChapterLink": ".*/ch/.*"},
    },
    {
        "url": "https://b.x/", "name": "b",
        "search": {"disabled": True, "result": "li", "bookName": "a"},
        "toc": {"baseUri": "https://b.x/dir/", "list": "#l", "item": "a", "nextPage": "a#next"},
        "chapter": {"content": "#c", "nextPage": "a.n"},
    },
    {"url": "https://c.x/", "name": "c", "disabled": True, "search": {"result": "li", "bookName": "a"}, "book": {"bookName": "h1@java:string.replace(\"x\",\"y\")", "author": "em"}},
]


def rules(spark):
    return R.parse_rules(spark, json.dumps(RULES))


def test_each_page_by_its_own_rule(spark):
    rows = [
        (BIG, "https://a.x/s?q=1", "<ul><li><a href='/1'>One</a><i>A</i><li><a href='/2'></a><li><a href='3'>Three</a></ul><h1> T </h1><h2>作者：W W</h2>"),
        (None, "https://b.x/", "<div id=l><a href='r.html'>B</a></div>"),
        (3, "https://c.x/1", "<h1>xx</h1><em>e</em>"),
        (4, "https://d.x/", "<li><a>lost</a>"),
        (5, "https://a.x/none", None),
        (5, "https://a.x/none", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = sites.read_sites(pages, rules(spark))
    assert [tuple(r)[:6] for r in sites.search_of(read).orderBy("pos").collect()] == [(BIG, 1, 0, "One", "https://a.x/1", "A"), (BIG, 1, 1, "Three", "https://a.x/3", "")]
    assert sorted((str(r["page_id"]), r["book_name"], r["author"]) for r in sites.books_of(read).collect()) == [("3", "yy", "e"), (str(BIG), "T", "W W")]
    assert [tuple(r) for r in sites.toc_of(read).collect()] == [(None, 2, 0, "B", "https://b.x/dir/r.html")]
    got = sorted(str(tuple(r)) for r in sites.rejected_of(read).collect())
    want = [(4, None, "rule", "no source"), (None, 2, "search", "the source is not searched"), (3, 3, "search", "the source is not searched"), (BIG, 1, "toc", "empty table of contents")]
    want += [(5, 1, "search", "no results"), (5, 1, "book", "no book name"), (5, 1, "toc", "empty table of contents")] * 2
    assert got == sorted(map(str, want))
    assert sites.search_of(sites.read_sites(pages, rules(spark), limit=1)).count() == 1
    assert sites.read_sites(pages.limit(0), rules(spark)).collect() == []


def test_tables_of_contents(spark):
    def items(*pairs):
        return "".join(f"<li><a href='{h}'>{t}</a></li>" for t, h in pairs)

    pages = [
        # a drop-down; its own first page stands second in it; /3 is listed twice, /4 was not captured
        ("https://a.x/toc/7/1", "<select><option value='/toc/7/3'><option value='/toc/7/2'><option value='/toc/7/1'><option value='https://a.x/toc/7/4'><option value='/toc/7/3'></select><ol>" + items(("c2", "/2"), ("c1", "/1")) + "</ol>"),
        ("https://a.x/toc/7/2", "<ol>" + items(("c0", "/0")) + "</ol>"),
        ("https://a.x/toc/7/3", "<ol>" + items(("c3", "/3"), ("c2", "/2b")) + "</ol>"),
        # a chain of three pages, relative to the base; the last link is no http link
        ("https://b.x/p", "<div id=l>" + items(("x", "x.html"), ("y", "/y")) + "</div><a id=next href='q'>next</a>"),
        ("https://b.x/dir/q", "<div id=l>" + items(("x", "//z.x/x")) + "</div><a id=next value='https://b.x/r'>next</a>"),
        ("https://b.x/r", "<div id=l><a>bare</a></div><a id=next href='https://b.x/dir/gone'></a>"),
        ("https://b.x/round", "<div id=l><a>1</a></div><a id=next href='/round2'></a>"),
        ("https://b.x/round2", "<div id=l><a>2</a></div><a id=next href='/round'></a>"),
        ("https://b.x/end", "<div id=l><a>1</a></div><a id=next href='/end2'></a>"),
        ("https://b.x/end2", "<div id=l><a>2</a></div><a id=next value='javascript:void'></a>"),
        ("https://b.x/empty", "<p>nothing</p>"),
    ]
    books = [(BIG, "https://a.x/book/7"), (None, "https://b.x/none"), (2, "https://b.x/p"), (3, "https://b.x/round"), (4, "https://b.x/end"), (5, "https://b.x/empty"), (6, "https://d.x/"), (8, "https://a.x/book/8")]
    made, rejected = sites.tables_of_contents(spark.createDataFrame(books, "book long, url string"), spark.createDataFrame(pages, "url string, html string"), rules(spark))
    got = {}
    for r in made.orderBy("index").collect():
        got.setdefault(r["book"], []).append((r["index"], r["title"], r["url"]))
    # pages 2, 1, 4, 3 (the last place of 3), each turned round; of c2 the last stays
    assert got == {
        BIG: [(1, "c0", "https://a.x/0"), (2, "c1", "https://a.x/1"), (3, "c2", "https://a.x/2b"), (4, "c3", "https://a.x/3")],
        4: [(1, "1", ""), (2, "2", "")],
    }
    assert sorted(str(tuple(r)) for r in rejected.collect()) == sorted(map(str, [
        (BIG, "https://a.x/toc/7/4", "not captured", False), (None, "https://b.x/none", "not captured", True), (2, "https://b.x/dir/gone", "not captured", True),
        (3, "https://b.x/round", "the pages go round", True), (5, "https://b.x/empty", "empty table of contents", True), (6, "https://d.x/", "no source", True), (8, "https://a.x/toc/8/1", "not captured", True),
    ]))


def test_chapters_by_rule(spark):
    a = lambda body, nxt, text="on": f"<div id=c><h3>drop</h3>{body}</div><a class=n>{text}</a><script id=s>var next='{nxt}';</script>"
    b = lambda body, href, text="on": f"<div id=c>{body}</div><a class=n href='{href}'>{text}</a>"
    pages = [("https://a.x/1", a("one,", "https://a.x/1_2.html")), ("https://a.x/1_2.html", a("two", "https://a.x/ch/2"))]
    pages += [(f"https://b.x/{k}", b(f"{k};", f"/{k + 1}", "没有了" if k == 304 else "on")) for k in range(1, 305)]
    pages += [("https://b.x/r1", b("r", "/r2")), ("https://b.x/r2", b("r", "/r3")), ("https://b.x/r3", b("r", "/r2"))]
    pages += [("https://b.x/g", b("g", "/gone")), ("https://b.x/e", b("e", "/e2")), ("https://b.x/e2", b("", "/e3")), ("https://b.x/last_2.html", b("l", "", "下一章"))]
    starts = ["https://a.x/1", "https://b.x/1", "https://b.x/1", "https://b.x/r1", "https://b.x/g", "https://b.x/e", "https://d.x/", "https://b.x/last_2.html"]
    chapters, rejected = sites.walk_chapters(spark, spark.createDataFrame([(s,) for s in starts], "start string"), spark.createDataFrame(pages, "url string, html string"), rules(spark))
    assert {r["start"]: (r["content"], r["n_pages"]) for r in chapters.collect()} == {
        "https://a.x/1": ("one,two", 2), "https://b.x/1": ("".join(f"{k};" for k in range(1, 305)), 304), "https://b.x/last_2.html": ("l", 1),
    }
    assert sorted(tuple(r) for r in rejected.collect()) == [
        ("https://b.x/e", "https://b.x/e2", "no content"), ("https://b.x/g", "https://b.x/gone", "not captured"), ("https://b.x/r1", "https://b.x/r2", "the pages go round"), ("https://d.x/", "https://d.x/", "no source"),
    ]


def test_walks_of_any_length_and_rounds(spark):
    starts = spark.createDataFrame([(0,), (500,), (700,), (900,)], "start long")
    links = [(k, k + 1) for k in range(0, 450)] + [(500, 501), (501, 502), (502, 501), (700, 700)]
    walk, rounds = toc.walk_links(spark, starts, spark.createDataFrame(links, "url long, next_url long"))
    by = {}
    for r in walk.orderBy("start", "depth").collect():
        by.setdefault(r["start"], []).append(r["url"])
    assert by == {0: list(range(451)), 500: [500, 501, 502], 700: [700], 900: [900]}
    assert sorted(tuple(r) for r in rounds.collect()) == [(500, 501), (700, 700)]


def test_single_rule_walk_rejects_rounds(spark):
    page = lambda n, to: (n, f"<div id=c>{n}</div><a class=n href='{to}'>on</a>")
    rows = [page("http://x/1", "http://x/2"), page("http://x/2", "http://x/1")]
    starts = spark.createDataFrame([("http://x/1",)], "start string")
    chapters, rejected = projections.chapter_walk(spark, starts, spark.createDataFrame(rows, "url string, html string"), "#c", "a.n")
    assert chapters.collect() == [] and [tuple(r) for r in rejected.collect()] == [("http://x/1", "the pages go round: http://x/1")]


def test_text_keeps_java_steps():
    e = dom.parse("<div><a href='/x'>a-b</a></div>")
    assert projections.extract_text(e, 'a@href@java:string.replace("-", "+")') == "a+b"
    assert projections.extract_text(e, 'a@href@js:r="p "+r@java:string.replace("-", "+")') == "p a+b"


def test_ids_beside_nulls_keep_every_digit(spark):
    pages = spark.createDataFrame([(BIG, "http://x/", "<li><a href=/a>t</a></li>"), (None, "http://x/", "<li><a href=/b>u</a></li>")], "page_id long, url string, html string")
    assert {r["page_id"] for r in projections.toc_items(pages, "a").collect()} == {BIG, None}
    assert {r["page_id"] for r in extract.list_rows(pages, "page_id", "li", {"t": "a"}, "t").collect()} == {BIG, None}
