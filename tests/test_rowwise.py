"""Page functions get few rows at a time, so that their memory follows the size of a page, and run once for each page."""

import os

import pytest

from quire.functions.rowwise import rows_of
from quire.operators import extract
from quire.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("name", "runs"), [("chapter_txt", 3), ("sites_rejected", 1), ("book_detail", 1), ("toc_entries", 1), ("page_rows", 1), ("implied_cells", 1), ("captured_files", 2)])
def test_pages_go_to_python_in_small_batches(spark, name, runs):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and plan.count("BatchEvalPython") == runs


def test_rows_of_keeps_keys_and_order(spark):
    df = spark.createDataFrame([(9007199254740993, "a b"), (None, "c"), (2, None), (3, "")], "k long, t string")
    got = rows_of(df, "k", ["t"], "pos int, w string", lambda t: enumerate((t or "").split())).where("w <> 'x'").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(9007199254740993, 0, "a"), (9007199254740993, 1, "b"), (None, 0, "c")], key=str)
    assert extract.list_rows(df.selectExpr("k", "t html", "t url"), "k", "p", {"a": "p"}, "a").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rows_of_one_file_are_dealt_to_many_tasks(spark):
    made = catalog.QUERIES["implied_cells"](spark, SF)
    assert made.selectExpr("spark_partition_id() task").distinct().count() > 16
