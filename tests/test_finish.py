import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import finish, projections, search
from quire.sources import artifacts
from quire.streaming import jobs

CHAPTERS = "book_name string, author string, index int, total int, title string, content string"


def chapters(spark):
    rows = [("B", "A", k, 11, f"t/{k}_x", f"text {k} 秋+%\n") for k in range(1, 12)] + [("C", "A", 1, 1, None, None)]
    return spark.createDataFrame([(b, a, k, n, t or "", c) for b, a, k, n, t, c in rows], CHAPTERS)


def test_cache_is_read_in_order_and_finished(spark, tmp_path):
    cache, out = str(tmp_path / "cache"), str(tmp_path / "out")
    finish.write_cache(finish.chapter_files(chapters(spark)), cache)
    finish.write_cache(finish.chapter_files(chapters(spark)), cache)  # again, as after a lost executor
    assert sorted(os.listdir(cache)) == ["B (A) TXT", "C (A) TXT"] and len(os.listdir(f"{cache}/B (A) TXT")) == 11
    open(f"{cache}/B (A) TXT/notes.txt", "w").write("last\n")
    open(f"{cache}/B (A) TXT/2_bad.txt", "wb").write(b"\xff\xfe")
    books = spark.createDataFrame([("B", "A", "<b>in</b>"), ("C", "A", ""), ("D", "A", "")], "book_name string, author string, intro string")
    done = finish.finish_books(spark, books, cache, out, "txt", keep_cache=True)
    assert sorted(r["name"] for r in done.collect()) == ["B(A).txt", "C(A).txt", "D(A).txt"] == sorted(os.listdir(out))
    assert open(f"{out}/B(A).txt").read() == "书名：B\n作者：A\n简介：in\n" + "".join(f"text {k} 秋+%\n" for k in range(1, 12)) + "last\n"
    assert open(f"{out}/D(A).txt").read() == "书名：D\n作者：A\n简介：暂无\n"
    finish.finish_books(spark, books, cache, out, "txt", "GBK")
    assert open(f"{out}/B(A).txt", "rb").read().decode("gbk").endswith("last\n") and os.listdir(cache) == []
    with pytest.raises(ValueError):
        finish.finish_books(spark, books, cache, out, "pdf")


def test_finished_epub_has_its_cover(spark, tmp_path):
    cache, out = str(tmp_path / "cache"), str(tmp_path / "out")
    finish.write_cache(finish.chapter_files(chapters(spark), "epub"), cache)
    books = spark.createDataFrame([("B", "A", "in", bytearray(b"jpeg")), ("D", "A", "", None)], "book_name string, author string, intro string, cover binary")
    assert [r["name"] for r in finish.finish_books(spark, books, cache, out, "epub").collect()] == ["B(A).epub"]
    names = zipfile.ZipFile(f"{out}/B(A).epub").namelist()
    assert "OEBPS/cover.jpg" in names and names[-1] == "OEBPS/chapter_11.xhtml" and sorted(os.listdir(cache)) == ["C (A) EPUB"]


def test_chapter_walk(spark):
    page = lambda body, href="", label="": f"<div id=c>{body}</div><a class=n href='{href}'>{label}</a>"
    rows = [
        ("http://x/1.html", page("one ", "1_2.html", "next")), ("http://x/1_2.html", page("two ", "1_3.html", "下一章")), ("http://x/1_3.html", page("three", "2.html", "下一章")),
        ("http://x/2.html", page("alone", "3.html", "没有了")), ("http://x/4.html", page("lost ", "5.html", "next")), ("http://x/6.html", page("", "7.html", "下一章")),
    ]
    pages = spark.createDataFrame(rows, "url string, html string")
    starts = spark.createDataFrame([(f"http://x/{k}.html",) for k in (1, 2, 4, 6)], "start string")
    good, bad = projections.chapter_walk(spark, starts, pages, "#c", "a.n")
    assert sorted(map(tuple, good.collect())) == [("http://x/1.html", "one two three", 3), ("http://x/2.html", "alone", 1)]
    assert sorted(map(tuple, bad.collect())) == [("http://x/4.html", "no content: http://x/5.html"), ("http://x/6.html", "no content: http://x/6.html")]


def test_ranks_over_ranges(spark):
    rows = [("ab"[k % 7 == 0], k % 5, k) for k in range(500)] + [("c", None, 1)]
    got = search.ranked(spark.createDataFrame(rows, "kw string, s int, k int").repartition(7), ["kw"], [F.col("s").desc(), F.col("k").asc()]).collect()
    for kw in "abc":
        mine = sorted((r["rank"], -r["s"] if r["s"] is not None else 0, r["k"]) for r in got if r["kw"] == kw)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert search.ranked(spark.createDataFrame([], "kw string, s int, k int"), ["kw"], [F.col("s").asc()]).collect() == []


def test_retries(spark):
    rows = [("a", 0, False, "x"), ("a", 1, True, None), ("a", 2, False, "z"), ("b", 0, False, "x"), ("b", 1, False, "y"), ("b", 2, False, "w"), ("b", 3, True, None), ("c", 0, True, None)]
    tries = spark.createDataFrame(rows, "k string, attempt int, ok boolean, error string")
    assert sorted(map(tuple, jobs.after_retries(tries, ["k"], 2, 100).collect())) == [("a", 1, True, None, 100), ("b", 2, False, "w", 300), ("c", 0, True, None, 0)]
    assert sorted(r["error"] or "" for r in jobs.after_retries(tries, ["k"], 0, 100).collect()) == ["", "x", "x"]


def test_old_files_and_job_ids(spark, tmp_path):
    for name, age in (("old.log", 9), ("new.log", 1)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (os.path.getmtime(tmp_path / name) - age * 86_400,) * 2)
    assert [r["name"] for r in finish.expired(artifacts.list_artifacts(spark, str(tmp_path)), 7).collect()] == ["old.log"]
    ids = [r["i"] for r in spark.range(100).select(T.job_id().alias("i")).collect()]
    assert len(set(ids)) == 100 and all(len(i) == 16 and int(i, 16) >= 0 for i in ids)
