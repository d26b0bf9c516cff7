import datetime
import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import search, toc
from quire.streaming import jobs


def test_search_threshold_and_fallback(spark):
    rows = spark.createDataFrame([(1, "steel", "x"), (2, "steal", "y"), (3, "zzzzz", "steel")], "id int, name string, author string")
    found = search.ranked_search(rows, ["steel", "qqqqqs"], "name", "author", ["id"]).orderBy("keyword", "rank").collect()
    assert [(r["keyword"], r["id"]) for r in found if r["keyword"] == "steel"] == [("steel", 1), ("steel", 2)]
    assert all(r["similarity"] > 0 for r in found)


def test_toc_keeps_the_last(spark):
    rows = spark.createDataFrame([(1, 0, "a", "u1"), (1, 1, "b", "u2"), (2, 0, "a", "u3")], "page_no int, pos int, title string, url string").withColumn("book", F.lit(1))
    assert [(r["index"], r["url"]) for r in toc.table_of_contents(rows, ["book"]).orderBy("index").collect()] == [(1, "u2"), (2, "u3")]
    assert [r["url"] for r in toc.table_of_contents(rows, ["book"], descending=True).orderBy("index").collect()] == ["u2", "u3"]


def test_next_pages_end_in_a_cycle(spark):
    nexts = spark.createDataFrame([("a", "b"), ("b", "a")], "url string, next_url string")
    starts = spark.createDataFrame([("a",)], "start string")
    assert toc.follow_next(spark, starts, nexts, max_depth=3).count() == 4


def test_next_pages_of_a_long_chain(spark):
    nexts = spark.createDataFrame([(k, k + 1) for k in range(150)] + [(150, None)], "url int, next_url int")
    starts = spark.createDataFrame([(0,), (100,)], "start int")
    got = {(r["start"], r["depth"], r["url"]) for r in toc.follow_next(spark, starts, nexts).collect()}
    assert got == {(0, k, k) for k in range(151)} | {(100, k, 100 + k) for k in range(51)}
    assert toc.follow_next(spark, starts, nexts, max_depth=0).count() == 2


def test_rejected_jobs_hold_no_place(spark):
    hour = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(1, hour(0), hour(9)), (2, hour(1), hour(9)), (3, hour(2), hour(4)), (4, hour(3), None)]
    df = spark.createDataFrame(rows, "job int, started timestamp, ended timestamp")
    assert {r["job"]: (r["active"], r["admitted"]) for r in jobs.admitted(df, 1).collect()} == {1: (0, True), 2: (1, False), 3: (1, False), 4: (1, False)}
    assert {r["job"]: (r["active"], r["admitted"]) for r in jobs.admitted(df, 2).collect()} == {1: (0, True), 2: (1, True), 3: (2, False), 4: (2, False)}


def test_snapshot_of_late_readers(spark):
    df = spark.createDataFrame([("a", 1, "downloading"), ("a", 2, "done"), ("b", 1, "fetching")], "job string, seq int, phase string")
    assert sorted(map(tuple, jobs.snapshot(df, "job").collect())) == [("a", 2, "done", True), ("b", 1, "fetching", False)]
    assert jobs.snapshot(df, "job", ["x"]).count() == 0


def test_projections(spark):
    from quire.operators import extract
    from quire.operators import projections as P

    html = """<table><tr><td><a href="/b/1">One</a><td>Ann</tr><tr><td><a>  </a></tr><tr><td><a href="b/2">Two</a><td>Bob</tr><tr><td><a href=x>Three</a></tr></table>
      <div id=list><a href=c1>C 1</a><a>C 2</a></div><select><option value="/p1"><option value="/p2"></select><a id=next href="n2">next</a>"""
    pages = spark.createDataFrame([(1, "http://h/d/i", html), (2, "http://h/", None)], "page_id int, url string, html string")
    got = [(r["book_name"], r["url"], r["author"]) for r in P.search_rows(pages, {"result": "tr", "book_name": "a@href", "author": "td:nth-child(2)"}, limit=2).collect()]
    assert got == [("One", "http://h/b/1", "Ann"), ("Two", "http://h/d/b/2", "Bob")]
    assert [tuple(r) for r in P.toc_items(pages, "a", "#list").collect()] == [(1, 0, "C 1", "http://h/d/c1"), (1, 1, "C 2", "")]
    assert [tuple(r) for r in P.toc_pages(pages, "option").collect()] == [(1, "list", 0, "http://h/p1"), (1, "list", 1, "http://h/p2")]
    assert [tuple(r) for r in P.toc_pages(pages, "#next").collect()] == [(1, "next", 0, "http://h/d/n2")]
    assert [r["page_id"] for r in P.without_entries(pages, P.toc_items(pages, "a"), "page_id").collect()] == [2]
    book = '<meta name="n" content="N"><meta name="a" content="作者：A"><meta name="i" content=" x y "><meta name="t" content="更新时间：now">'
    pages = spark.createDataFrame([(1, "u", book), (2, "u", '<meta name="n" content="N">'), (3, "u", None)], "page_id int, url string, html string")
    rule = {"book_name": 'meta[name="n"]', "author": 'meta[name="a"]', "intro": 'meta[name="i"]', "last_update_time": 'meta[name="t"]'}
    kept, rejected = P.book_details(pages, rule)
    assert [(r["book_name"], r["author"], r["intro"], r["last_update_time"]) for r in kept.collect()] == [("N", "A", "xy", "now")]
    assert sorted(map(tuple, rejected.collect())) == [(2, "no author"), (3, "no book name")]
    assert extract.lowered(F.col("html"), "title@js:r=r.replace(/b+/,'c')") is None


def test_fold_stops_at_a_terminal_phase():
    events = pd.DataFrame([("total", 1, "", "", 2), ("done", 2, "c1", "", 0), ("phase", 3, "", "done", 0), ("failed", 4, "c2", "", 0)], columns=["kind", "seq", "current", "phase", "n"])
    assert jobs.fold(None, events) == {"total": 2, "done": 1, "failed": 0, "current": "c1", "phase": "done", "seq": 3}


def test_admission_counts_jobs_under_way(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 02:00:00'),
      (2, timestamp'2024-01-01 00:30:00', timestamp'2024-01-01 00:40:00'), (3, timestamp'2024-01-01 01:00:00', NULL) AS t(job, started, ended)""")
    assert {r["job"]: r["active"] for r in jobs.admitted(rows, 2).collect()} == {1: 0, 2: 1, 3: 1}


def test_progress_stream(spark, tmp_path):
    rows = [("j", 1, "total", "", "", 2), ("j", 2, "done", "c1", "", 0), ("k", 1, "failed", "c", "", 0), ("j", 3, "phase", "", "done", 0)]
    folder = tmp_path / "events"
    spark.createDataFrame(rows, "job_id string, seq long, kind string, current string, phase string, n long").write.parquet(str(folder))
    stream = spark.readStream.schema("job_id string, seq long, kind string, current string, phase string, n long").parquet(str(folder))
    q = jobs.progress_stream(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["job_id"]: (r["total"], r["done"], r["failed"], r["phase"]) for r in spark.table("states").collect()}
    assert got == {"j": (2, 1, 0, "done"), "k": (0, 0, 1, "fetching")}


def test_payloads(spark):
    states = spark.createDataFrame([("j", 2, 1, 0, "c", "done")], "job string, total long, done long, failed long, current string, phase string")
    r = jobs.event_payload(states).first()
    assert r["type"] == "done" and json.loads(r["payload"])["index"] == 1


def test_suggestions_from_payloads(spark):
    rows = spark.createDataFrame([('{"g":[{"q":"a"},{"q":"b"}]}',), ("broken",)], "p string")
    assert [r["suggestions"] for r in search.suggestions_from_json(rows, "p", 1).collect()] == [["a"], []]


def test_admission_keeps_ids_beside_nulls(spark):
    big = 9007199254740993
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(big, at, None), (None, at, at), (big + 1, None, None)], "job long, started timestamp, ended timestamp")
    assert {r["job"]: r["active"] for r in jobs.admitted(df, 5).collect()} == {big: 0, None: 1, big + 1: 2}


def test_admission_as_a_stream_decides_as_in_batch(spark, tmp_path):
    import random

    r = random.Random(8)
    asks = [(pool, f"{pool}{k}", 10 * k, 10 * k + r.choice([5, 25, 45, 10_000])) for pool in "ab" for k in range(40)]
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(p, j, at(a), at(b)) for p, j, a, b in asks], "pool string, job string, started timestamp, ended timestamp")
    want = {x["job"]: (x["active"], x["admitted"]) for x in jobs.admitted(df, 3, "pool").collect()}
    events = sorted([(2 * a + 1, p, j, "ask") for p, j, a, _ in asks] + [(2 * b, p, j, "end") for p, j, _, b in asks])
    folder, got = str(tmp_path), {}
    for k in range(0, len(events), 60):  # each part is a batch of its own, on one checkpoint
        part = [(p, s, j, kind) for s, p, j, kind in events[k : k + 60]]
        spark.createDataFrame(part, "pool string, seq long, job string, kind string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.admission_stream(spark.readStream.schema("pool string, seq long, job string, kind string").parquet(f"{folder}/in"), 3)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    for x in spark.read.parquet(f"{folder}/out").collect():
        got[x["job"]] = (x["active"], x["admitted"])
    assert got == want and {v[1] for v in want.values()} == {True, False}
