"""Suggestions for tables of prefixes, and conversion by phrases, against plain definitions."""

import random
import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.functions import dom, lang
from quire.operators import extract, projections, search, sites
from quire.sources import charset


def test_suggestions_for_many_prefixes(spark):
    r = random.Random(2)
    names = ["".join(r.choice("ab ") for _ in range(r.randint(0, 12))) for _ in range(300)] + [None, "", "ünder", "üb"]
    asked = sorted({n[:k] for n in names if n for k in (1, 2, 5, 11)}) + ["zz", "", "  "]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    requests = spark.createDataFrame([(p, k) for k, p in enumerate(asked + asked[:2])], "q string, id int")
    got = {}
    for x in search.suggestions_for(requests, "q", df, "name", longest=4, n=3).collect():
        got.setdefault(x["id"], {})[x["rank"]] = x["name"]
    want = {}
    for k, p in enumerate(asked + asked[:2]):
        fit = sorted({n for n in names if n and n.startswith(p)}, key=lambda n: n.encode())[:3] if p.strip() else []
        if fit:
            want[k] = dict(enumerate(fit, 1))
    assert got == want


def plain(text, pairs, characters):
    """At each place the longest phrase, else the character."""
    out, at = "", 0
    while at < len(text):
        fit = max((p for p in pairs if p[0] and text.startswith(p[0], at)), key=lambda p: len(p[0]), default=None)
        out += fit[1] if fit else text[at].translate(str.maketrans(*characters))
        at += len(fit[0]) if fit else 1
    return out


def test_overlapping_phrases():
    r = random.Random(3)
    pairs = [("ab", "X"), ("abc", "Y"), ("bca", "Z"), ("X", "no"), ("ca", "ab"), ("aab", "")]
    made = lang.Phrases(pairs, ("c", "C"))
    for _ in range(500):
        text = "".join(r.choice("abcX") for _ in range(r.randint(0, 30)))
        assert made.convert(text) == plain(text, pairs, ("c", "C"))
    assert lang.Phrases([]).convert("as it is") == "as it is"


def test_conversion_by_phrases(spark):
    df = spark.createDataFrame([("软件和国书，出租车",), (None,), ("",), ("軟件",)], "t string")
    assert [r[0] for r in df.select(lang.convert(F.col("t"), "s2tw")).collect()][:3] == ["软件和國書，計程車", None, ""]
    back = spark.createDataFrame([("滑鼠與軟體",)], "t string").select(lang.convert(F.col("t"), "t2s")).first()[0]
    assert back == "鼠標与軟件".translate(str.maketrans(lang.TRADITIONAL, lang.SIMPLIFIED))
    assert df.select(lang.convert(F.col("t"), "t2tw")).collect()[3][0] == "軟體"


def test_limits_are_capped():
    assert [search.capped_limit(*x) for x in [(None, 30), (50, 30), (10, 30), (30, 30), (50, 0), (0, 30), (-1, 30)]] == [0, 30, 10, 30, 50, 0, 0]


def test_attributes_of_all_matches(spark):
    rows = [(9007199254740993, "http://x/y/", "<table><tr><td><img src=/a><img><img src=b></table>"), (2, "http://x/", None), (None, "http://x/", "<img src=c>"), (3, None, "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {tuple(r) for r in projections.attribute_rows(pages, "img", "src").collect()}
    assert got == {(9007199254740993, 0, "http://x/a"), (9007199254740993, 1, "http://x/y/b"), (None, 0, "http://x/c")}
    assert projections.attribute_rows(pages, "((", "src").count() == 0


def test_unusable_selectors_in_tasks(spark):
    page = spark.createDataFrame([(1, "http://x/", "<p>a</p>")], "page_id long, url string, html string")
    assert extract.extract_fields(page, {"a": "((", "b": "//html/p", "c": "p"}).select("a", "b", "c").first() == ("", "", "a")
    assert extract.list_rows(page, "page_id", "a::before", {"a": "p"}, "a").count() == 0


def test_functions_run_where_the_package_is_not(tmp_path):
    """What goes to tasks needs no copy of the package there."""
    calls = [
        (extract.extract, (dom.parse("<p>a</p>"), "p"), "a"),
        (extract.extract_all, (dom.parse("<p>a</p>"), "((", "href"), []),
        (charset.decode_bytes, ("中文字".encode("gb18030"),), charset.decode_bytes("中文字".encode("gb18030"))),
        (sites._whole, ("a+",), None),
    ]
    for k, (function, args, want) in enumerate(calls):
        (tmp_path / "f").write_bytes(cloudpickle.dumps((function, args, want)))
        code = f"import sys, pickle; f, a, w = pickle.load(open({str(tmp_path / 'f')!r}, 'rb')); r = f(*a); assert w is None or r == w, r; assert not any(m.startswith('quire') for m in sys.modules)"
        subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, check=True)
