"""Tables of contents: order keys, keep-last dedup, renumbering, and pages that follow one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def page_order(rows: DataFrame, descending: bool, pos: str = "pos") -> DataFrame:
    """rows with `pos` turned round within each page if entries are listed last first; pages keep their order."""
    return rows.withColumn(pos, -F.col(pos)) if descending else rows


def keep_last(rows: DataFrame, book: list[str], title: str, order: list[str]) -> DataFrame:
    """Of entries with equal title, the last in order, at its own place."""
    last = W.partitionBy(*book, title).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def renumber(rows: DataFrame, book: list[str], order: list[str], index: str = "index") -> DataFrame:
    """rows with 1..n in order, for each book."""
    return rows.withColumn(index, F.row_number().over(W.partitionBy(*book).orderBy(*order)))


def table_of_contents(rows: DataFrame, book: list[str], descending: bool = False) -> DataFrame:
    """rows (book..., page_no, pos, title, url) as a clean table of contents."""
    ordered = page_order(rows, descending)
    return renumber(keep_last(ordered, book, "title", ["page_no", "pos"]), book, ["page_no", "pos"])


def first_by_url(rows: DataFrame, by: list[str], url: str, order: list[str]) -> DataFrame:
    """Of rows with equal url, the first in order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by, url).orderBy(*order))).where("__n = 1").drop("__n")


def walk_links(spark: SparkSession, starts: DataFrame, nexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(walk, rounds): walk (start, depth, url) has the pages that follow each start, itself first, by next links, however many
    there are; rounds (start, url) names the walks that come back to a page they have already taken: they end before it.

    starts: (start); nexts: (url, next_url) with one row for a url. Links are doubled in length each round, so walks of n
    pages take log2(n) rounds, each cut from the one before.
    """
    walk = cut(starts.select("start", F.lit(0).alias("depth"), F.col("start").alias("url")))
    jump = nexts.where(F.col("next_url").isNotNull()).select("url", F.col("next_url").alias("to"))
    ended, rounds, length = walk.limit(0), walk.select("start", "url").limit(0), 1
    while True:
        on = cut(walk.join(jump, "url").select("start", (F.col("depth") + length).alias("depth"), F.col("to").alias("url")))
        if on.isEmpty():
            return ended.unionByName(walk), rounds
        both = walk.unionByName(on)
        again = both.groupBy("start", "url").agg(F.get(F.sort_array(F.collect_list("depth")), F.lit(1)).alias("at")).where("at IS NOT NULL")
        closed = cut(again.groupBy("start").agg(F.min("at").alias("at"), F.min_by("url", "at").alias("__url")))
        rounds = cut(rounds.unionByName(closed.select("start", F.col("__url").alias("url"))))
        ended = cut(ended.unionByName(both.join(closed, "start").where("depth < at").select("start", "depth", "url")))
        walk = cut(both.join(closed.select("start"), "start", "left_anti"))
        jump = cut(jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("__far")), "to").select("url", F.col("__far").alias("to")))
        length *= 2


def follow_next(spark: SparkSession, starts: DataFrame, nexts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, depth, url): the walks of walk_links(): all of their pages, and walks that go round end before their first repeated
    page. With max_depth, walks end there instead, also those that go round.
    """
    if max_depth is None:
        return walk_links(spark, starts, nexts)[0]
    walk = starts.select("start", F.lit(0).alias("depth"), F.col("start").alias("url"))
    jump = nexts.where(F.col("next_url").isNotNull()).select("url", F.col("next_url").alias("to"))
    length = 1
    while length <= max_depth and not jump.isEmpty():
        on = walk.where(F.col("depth") + length <= max_depth).join(jump, "url").select("start", (F.col("depth") + length).alias("depth"), F.col("to").alias("url"))
        walk, length = cut(walk.unionByName(on)), 2 * length
        if length <= max_depth:
            jump = cut(jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("__far")), "to").select("url", F.col("__far").alias("to")))
    return walk
