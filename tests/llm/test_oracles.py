"""Queries against their SQL over a small data folder."""

import os

import pytest

from compare import spark_rows, sql_rows
from quire.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == sql_rows(registry.ORACLE[name], SF)
