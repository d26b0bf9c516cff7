"""Readers of live progress: early, late, lagging, of ended and unknown jobs; batches that are run again."""

import pytest

from quire.streaming import subscribe

EVENTS = "job_id string, seq long, kind string, current string, phase string, n long"
BATCHES = [
    [("a", 0, "total", None, None, 5), ("a", 1, "phase", None, "downloading", 0)],
    [("a", 2, "done", "c1", None, 0), ("b", 0, "phase", None, "fetching", 0)],
    [("a", 3, "done", "c2", None, 0)],
    [("a", 4, "failed", "c3", None, 0), ("b", 1, "phase", None, "failed", 0)],
    [("a", 5, "phase", None, "done", 0)],
    [("a", 6, "done", "too late", None, 0), ("c", 0, "total", None, None, 2)],
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("live"))
    for batch in BATCHES:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{top}/in")
        subscribe.keep_states(spark.readStream.schema(EVENTS).parquet(f"{top}/in"), f"{top}/states", compact=2, once=True).awaitTermination()
    return f"{top}/states"


def got(spark, folder, readers, upto, **more):
    df = spark.createDataFrame(readers, "reader string, job_id string, joined int, read int")
    out = {}
    for r in subscribe.messages(spark, folder, df, upto, **more).orderBy("reader", "pos").collect():
        out.setdefault(r["reader"], []).append((r["kind"], r["done"], r["seq"]))
    return out


def test_readers(spark, folder):
    assert subscribe._versions(spark, folder) == [1, 3, 5]
    readers = [("early", "a", 0, None), ("late", "a", 3, None), ("after the end", "a", 5, None), ("failed", "b", 1, None), ("unknown", "x", 0, None), ("not yet", "c", 0, None), ("goes on", "a", 0, 2), ("has read all", "a", 0, 4), ("any", None, 2, None)]
    assert got(spark, folder, readers, 5) == {
        "early": [("snapshot", 0, 1), ("progress", 1, 2), ("progress", 2, 3), ("progress", 2, 4), ("done", 2, 5)],
        "late": [("snapshot", 2, 4), ("done", 2, 5)],
        "after the end": [("done", 2, 5)],
        "failed": [("snapshot", 0, 0), ("error", 0, 1)],
        "not yet": [("progress", 0, 0)],
        "goes on": [("progress", 2, 4), ("done", 2, 5)],
        "any": [("snapshot", 2, 3), ("progress", 2, 4), ("done", 2, 5)],
    }
    assert got(spark, folder, [("early", "a", 0, None)], 1) == {"early": [("snapshot", 0, 1), ("progress", 1, 2)]}


def test_lagging_reader_heals(spark, folder):
    assert got(spark, folder, [("slow", "a", 0, 0)], 5, capacity=2) == {"slow": [("lagged", None, None), ("progress", 2, 4), ("done", 2, 5)]}
    assert got(spark, folder, [("new", "a", 0, None)], 5, capacity=1) == {"new": [("snapshot", 0, 1), ("lagged", None, None), ("done", 2, 5)]}


def test_snapshots_equal_the_log(spark, folder):
    for batch in range(6):
        by_log = subscribe.last_states(subscribe._log(spark, folder).where(f"batch <= {batch}"))
        assert sorted(map(tuple, subscribe.states_at(spark, folder, batch).collect())) == sorted(map(tuple, by_log.collect()))
