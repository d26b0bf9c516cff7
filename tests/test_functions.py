import base64

import pytest
from pyspark.sql import functions as F

from quire.functions import dom, lang, steps
from quire.functions import text as T
from quire.operators import assemble, content, extract
from quire.sources import artifacts, charset, config, rules


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


def test_native_text_functions(spark):
    c = F.col("a")
    assert one(spark, T.strip_invisible(c), a="a\n\tb​c") == "abc"
    assert one(spark, T.strip_entities(c), a="x&nbsp;y & z; w") == "xy  w"
    assert one(spark, T.drop_empty_tags(c), a="<div><p> </P><B></b>x</div>") == "<div>x</div>"
    assert one(spark, T.number_title(c), a="12 . Name") == "第12章 Name"
    assert one(spark, T.filter_text(c, r"(a)\1"), a="aab") == "aab"  # refers back: no filter
    assert one(spark, T.filter_text(c, "("), a="a(b") == "a(b"
    assert one(spark, T.filter_text(c, r"\s"), a="a　b") == "ab"
    assert one(spark, T.similarity(c, F.lit("")), a="") == 1.0
    assert one(spark, T.similarity(c, F.lit("ab")), a="a😀b") == pytest.approx(2 / 3)
    assert one(spark, T.percent_encode(c), a="a b*~é") == "a%20b%2A~%C3%A9"
    assert one(spark, T.safe_file_name(c), a="a.b:c/d") == "a。b：c／d"
    assert one(spark, T.origin(c), a="http://x/y") == "http://x"
    assert one(spark, T.origin(c), a="nothing") is None
    assert one(spark, T.book_id(c, r"/b/(\d+)@js:r"), a="http://x/b/42/") == "42"
    assert one(spark, T.book_id(c, r"/b/\d+"), a="http://x/b/42/") is None
    assert one(spark, T.drop_heading(c, F.lit("One (1)")), a="<b> One (1)text") == " text"


@pytest.mark.parametrize(
    "value, base, expected",
    [("http://a/b", "http://x/y/z", "http://a/b"), ("/b", "http://x/y/z", "http://x/b"), ("b", "http://x/y/z", "http://x/y/b"), ("b", "http://x", "http://x/b"), ("//h/b", "https://x/y", "https://h/b"), ("b", "", "b")],
)
def test_links_in_full(spark, value, base, expected):
    assert one(spark, T.absolute_url(F.col("a"), F.col("b")), a=value, b=base) == expected
    assert extract.join_url(value, base) == expected


@pytest.mark.parametrize(
    "url, text, expected",
    [(None, "", True), ("", "", True), ("c_2.html", "下一章", False), ("c.html", "下一章", True), ("c.html", "next", False), ("c.html", ">>", True)],
)
def test_last_page(spark, url, text, expected):
    assert one(spark, T.is_last_page(F.col("a"), F.col("b")), a=url, b=text) is expected


def test_base64_skips_what_does_not_decode(spark):
    good = base64.b64encode("秋a".encode()).decode()
    assert one(spark, T.decode_base64_lines(F.col("a")), a=f"{good}\nabc\n!!\n{good}") == "秋a秋a"
    assert steps.decode_b64(f"{good} abc {good}") == "秋a秋a"


def test_form(spark):
    made = one(spark, T.form_fields(F.col("a"), F.lit("kw")), a="{key: %s, bad, 'q' : \"x:y\"}")
    assert [(r["k"], r["v"]) for r in made] == [("key", "kw"), ("q", "x:y")]


def test_expressions():
    x = steps.parse("div.a > a@href@js:r='http://x'+r;@java:base64.decode()")
    assert (x.css, x.attr, [s.name for s in x.steps]) == ("div.a > a", "href", ["prefix", "base64"])
    assert steps.parse('meta[name="description"]').attr == "content"
    assert steps.parse("a@js:nonsense()").steps[0].name == ""
    assert steps.run(steps.parse("a@js:r=r.replace(/b+/g,'c')").steps[0], "abba") == "aca"
    assert steps.run(steps.named_step("js", "sort_by_data_id()"), '<i data-id="10">b</i><i data-id="9">a</i>') == "<p>a</p><p>b</p>"
    assert steps.run(steps.named_step("js", "visible_li_slice('1','1')"), "<li>a</li><li>b</li><li>c</li>") == "<li>b</li>"


@pytest.mark.parametrize("code", ["prefix('x')", "remove('a')", "regex_remove('a+')", "match1('a(.)')", "sort_by_data_id()", "visible_li_slice('1','0')", "jsonp_field('content')", "nothing", "r=r.replace('a','é')", "r=r.replace('<li>','')", "r=r.replace('','x')"])
@pytest.mark.parametrize("text", ["", "aab", 'cb({"content":"z"});', '<li>1</li><li>2</li><i data-id="2">b</i><i data-id="1">a</i>'])
def test_steps_agree_natively(spark, code, text):
    step = steps.named_step("js", code)
    assert one(spark, steps.column(step, F.col("a")), a=text) == steps.run(step, text)


PAGE = """<html><head><title> T </title><meta name="description" content="d"></head><body>
<ul id=l><li class="x y"><a href="/a">A</a><li><a href=b>B</a><li><a>C</a></ul>
<p>one<p>two<div><p>three</div><dl><dt>1<dd>2<dd>3</dl></body></html>"""


@pytest.mark.parametrize(
    "selector, texts",
    [("#l > li", ["A", "B", "C"]), ("li.x.y a", ["A"]), ("li:nth-child(2)", ["B"]), ("li:not(.x)", ["B", "C"]), ("li ~ li", ["B", "C"]), ("li + li:last-child", ["C"]), ("p, dd", ["one", "two", "three", "2", "3"]), ("dd:nth-of-type(2)", ["3"]), ("a[href=b]", ["B"]), ("li:nth-child(2n+1)", ["A", "C"]), ("div > p", ["three"])],
)
def test_selectors(selector, texts):
    assert [e.text().strip() for e in dom.select(dom.parse(PAGE), selector)] == texts


@pytest.mark.parametrize("selector", ["", "a >", "//html/a", "a::before", "a:hover"])
def test_selectors_outside_the_subset(selector):
    assert extract.extract(dom.parse(PAGE), selector) is None
    with pytest.raises(dom.SelectorError):
        dom.compiled(selector)


def test_extraction():
    root = dom.parse(PAGE)
    assert extract.extract(root, "title") == "T"
    assert extract.extract(root, 'meta[name="description"]') == "d"
    assert extract.extract(root, "li a@href", "http://x/y") == "http://x/a"
    assert extract.extract_all(root, "li a", "href", "http://x/y/z") == ["http://x/a", "http://x/y/b"]
    assert extract.extract(root, "table") is None
    assert extract.extract_inner(root, "li.x", "a") == ""


@pytest.mark.parametrize(
    "html, tags, expected",
    [("a<div>b<div>c</div></div>d", "div", "ad"), ("<p style=x>a</p><p>b</p>", "p[style=x]", "<p>b</p>"), ("a<br>b<BR/>c", "br", "abc"), ("<divx>a</divx>", "div", "<divx>a</divx>"), ("<div>a", "div", "<div>a"), ("é<h3>a</h3>é", "h3, h4", "éé"), ("<p>a</p>", ".cls, #id", "<p>a</p>")],
)
def test_remove_tags(html, tags, expected):
    assert extract.remove_tags(html, tags) == expected


def test_paragraphs():
    assert extract.paragraphs_closed("<span>a</span><p><b>c</b></p>") == "<p>a</p><p><p>c</p></p>"
    assert extract.clear_attributes('<p class="x">a b</p>\n') == "<p>ab</p>"
    assert extract.remove_selected("<body><p>a</p><i class=x>b</i></body>", "i.x") == "<p>a</p>"
    assert extract.remove_selected("<p>a</p>", "((") == "<p>a</p>"


def test_chapter(spark):
    rows = spark.createDataFrame([(1, "1.One", "1.One<br>a b&nbsp;<br><br>c<i></i>"), (2, "Two", None)], "n int, title string, content string")
    ok, empty = content.accepted(rows)
    made = content.render_chapters(ok, content.ChapterRule(paragraph_tag="<br>")).first()
    assert (made["title"], made["content"]) == ("第1章 One", "第1章 One\n\n　　ab\n　　c\n")
    assert [r["n"] for r in empty.collect()] == [2]
    assert "<title>a &lt; b</title>" in one(spark, content.render_xhtml(F.col("a"), F.lit("")), a="a < b")


def test_books(spark):
    import io
    import zipfile

    data = assemble.epub_bytes("B", "A", "", [("t1", "<p>1</p>"), ("t2", "<p>2</p>")])
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert names[0] == "mimetype" and names[-1] == "OEBPS/chapter_2.xhtml"
    assert data == assemble.epub_bytes("B", "A", "", [("t1", "<p>1</p>"), ("t2", "<p>2</p>")])
    with pytest.raises(ValueError):
        assemble.epub_bytes("B", "A", "", [])
    assert assemble.encoded("a😀", "GB18030") == b"a&#128512;"
    files = spark.createDataFrame([("10_a.txt",), ("2_b.txt",), ("x.txt",), ("1_c.txt",)], "name string")
    assert [r["name"] for r in files.orderBy(assemble.file_order(F.col("name"))).collect()] == ["1_c.txt", "2_b.txt", "10_a.txt", "x.txt"]


def test_written_texts(spark, tmp_path):
    books = spark.createDataFrame([("a/b", "x"), ("c", "秋")], "name string, text string")
    assemble.write_texts(books, str(tmp_path), "GBK")
    listed = {r["name"]: r["size"] for r in artifacts.list_artifacts(spark, str(tmp_path)).collect()}
    assert listed == {"a／b": 1, "c": 2}
    assert artifacts.read_artifact(str(tmp_path), "c").decode("gbk") == "秋"
    for name, error in ((" ", ValueError), ("../x", PermissionError), ("/etc/passwd", PermissionError), ("none", FileNotFoundError)):
        with pytest.raises(error):
            artifacts.artifact_path(str(tmp_path), name)
    artifacts.delete_artifact(str(tmp_path), "c")
    assert artifacts.list_artifacts(spark, str(tmp_path / "none")).count() == 0


def test_charsets():
    assert charset.decode_bytes("秋天".encode("gbk"), "text/html; charset=GBK") == "秋天"
    assert charset.decode_bytes("秋天".encode("gbk")) == "秋天"
    assert charset.decode_bytes("秋天".encode(), None) == "秋天"
    assert charset.decode_bytes(None) is None
    assert charset.decode_bytes(b"") == ""
    assert charset.decode_bytes(b"\xef\xbb\xbfa", "text/html; charset=gbk") == "a"
    assert charset.decode_bytes("秋".encode("utf-16"), None) == "秋"


@pytest.mark.parametrize("text", ["Éè, par, le", "que ierai un. Èé", "| aitionoi, | oueuxen.\nÉç", "la de avec. Êê"])
def test_lone_accented_words(text):
    assert charset.decode_bytes(text.encode("iso-8859-1")) == text


@pytest.mark.parametrize("text", ["Çèen en vich de.", "EAI!! DU!! ÈÈEUX", "un été. Éèlean"])
def test_accented_letters_in_short_texts(text):
    assert charset.decode_bytes(text.encode("iso-8859-1")) == text


JAPANESE = ["秋の風が北から吹いて、木の葉が一枚ずつ落ちる。", "彼は部屋に入り、机の上の手紙を見た。", "明日いっしょに図書館へ行きましょう。"]
SAMPLES = {
    "gb18030": ["秋天的风从北方吹来，树叶一片片落下。", "他走进房间，看见桌上放着一封信。", "不知道为什么，她突然笑了起来。", "第一章 少年离开了家乡"],
    "big5": ["秋天的風從北方吹來，樹葉一片片落下。", "他走進房間，看見桌上放著一封信。", "不知道為什麼，她突然笑了起來。", "第一章 少年離開了家鄉"],
    "cp932": JAPANESE,
    "euc_jp": JAPANESE,
    "cp949": ["가을 바람이 북쪽에서 불어와 나뭇잎이 떨어진다.", "그는 방에 들어가 책상 위의 편지를 보았다.", "제일장 소년은 고향을 떠났다"],
    "cp1252": ["Café", "L’été dernier, nous étions à la plage.", "Die Straße führt über die Brücke.", "El niño comió una manzana en el jardín."],
}


@pytest.mark.parametrize("codec", SAMPLES)
def test_charsets_by_likelihood(codec):
    wrong = n = 0
    for text in SAMPLES[codec]:
        for k in range(len(text) - 7):  # any eight characters
            part = text[k : k + 8]
            if not part.isascii():
                n += 1
                wrong += charset.decode_bytes(part.encode(codec)) != part
    assert wrong <= n // 50
    whole = "\n".join(SAMPLES[codec])
    for raw, right in ((whole.encode(codec), codec), (whole.encode(), "utf-8")):
        for spoilt in (raw[:-1], raw[:20] + b"\xff" + raw[20:], raw + b"\x80"):  # cut short, or with a broken byte
            assert charset.detect(spoilt) == right or spoilt.decode("utf-8", "ignore").encode() == spoilt


def test_captured_files(spark):
    rows = [("a", "秋天的风从北方吹来".encode("gbk"), None, 1), ("b", None, "text/html", 2), ("c", b"x" * 101, None, 3), ("d", b"<title>403 Forbidden</title>", None, 4), ("e", b"", None, 5), ("e", b"", None, 5)]
    files = spark.createDataFrame(rows, "url string, data binary, content_type string, extra int")
    got = sorted((r["url"], r["html"], r["reason"], r["extra"]) for r in charset.captured(files, most=100).collect())
    assert got == [("a", "秋天的风从北方吹来", None, 1), ("b", None, "no body", 2), ("c", None, "too large", 3), ("d", None, "challenge page", 4), ("e", "", None, 5), ("e", "", None, 5)]
    assert charset.captured(files.limit(0)).count() == 0


@pytest.mark.parametrize("s, t, how", [("zh-TW", "zh-CN", "t2s"), ("zh_tw", "zh-cn", "t2s"), ("zh-Hant", "zh-CN", "t2s"), ("zh-CN", "zh-TW", "s2tw"), ("zh-CN", "zh-Hant", "s2t"), ("zh-Hant", "zh-TW", "t2tw"), ("zh-CN", "zh-CN", None), ("en", "zh-CN", None)])
def test_directions(s, t, how):
    assert lang.direction(s, t) == how


def test_scripts(spark):
    assert len(lang.SIMPLIFIED) == len(lang.TRADITIONAL)
    assert one(spark, lang.convert(F.col("a"), "s2t"), a="国书，a") == "國書，a"
    assert one(spark, lang.convert(F.col("a"), "t2s"), a="國書") == "国书"


def test_rules(spark):
    text = '[{"url":"http://a/","name":"A","unknown":1,"search":{"url":"x"},"book":{"author":"b"},"toc":{"timeout":5}},{"url":"http://b/","name":"B","disabled":true}]'
    r = rules.parse_rules(spark, text).orderBy("id").collect()
    assert [x["id"] for x in r] == [1, 2]
    assert r[0]["language"] == "zh-CN" and r[0]["search"]["timeout"] == 15 and r[0]["toc"]["timeout"] == 5
    assert r[0]["book"]["author"] == "b" and r[0]["book"]["intro"] == 'meta[name="description"]' and r[0]["book"]["baseUri"] == "http://a/"
    assert [x["name"] for x in rules.source_list(rules.parse_rules(spark, text)).collect()] == ["A"]
    with pytest.raises(Exception):
        rules.parse_rules(spark, '[{"url":"http://a/","disabled":"true"}]').collect()
    with pytest.raises(ValueError):
        rules.replace_rules(spark, "[]")
    assert rules.replace_rules(spark, text) == 2
    settings = rules.crawl_settings(rules.parse_rules(spark, '[{"crawl":{"concurrency":500}},{}]'), {"concurrency": 50, "maxAttempts": 3}).orderBy("id").collect()
    assert [(s["concurrency"], s["maxAttempts"]) for s in settings] == [(100, 3), (50, 3)]


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("[jobs]\nmax_jobs = 7\nother = 1\n")
    assert config.load_config(str(tmp_path / "c.toml")).max_jobs == 7
    assert config.checked_request("http://x", language="zh_tw")["language"] == "zh-TW"
    for bad in (("",), ("http://x", "pdf"), ("http://x", "", "en"), ("http://x", "", "", 500)):
        with pytest.raises(ValueError):
            config.checked_request(*bad)
