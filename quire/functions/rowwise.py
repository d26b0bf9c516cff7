"""Python functions over pages, row by row.

Arrow batches hold ten thousand rows whatever their size, so that memory in Python follows the number of pages in a task.
Plain functions get a hundred rows at a time: memory follows the size of a page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def by_row(function: Callable, returns: str | DataType = "string") -> Callable[..., Column]:
    return F.udf(function, returns, useArrow=False)


def rows_of(df: DataFrame, key: str, columns: list[str], schema: str, of_row: Callable[..., Iterable[tuple]]) -> DataFrame:
    """(key, made...): the rows that of_row makes of the columns; the key never goes through Python."""
    made = by_row(lambda *row: list(of_row(*row)), ArrayType(StructType.fromDDL(schema))).asNondeterministic()  # else inline()'s own filter runs it twice
    return df.select(key, made(*columns).alias("__rows")).select(key, F.inline("__rows"))
