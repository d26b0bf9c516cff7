"""Aggregated search: candidates are scored by edit-distance similarity, ranked per keyword with an adaptive threshold.

Keywords are a small stated set; each candidate row is expanded by them, so candidates are read once and never shuffled
before the per-keyword sums, which are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut

THRESHOLD = 0.25


def searchable(sources: DataFrame) -> DataFrame:
    """Sources that can be searched: neither the source nor its search is off, its url is set and holds no script."""
    s = F.col("search")
    return sources.where(~F.coalesce("disabled", F.lit(False)) & ~F.coalesce(s["disabled"], F.lit(False)) & (F.coalesce(s["url"], F.lit("")) != "") & ~F.contains(s["url"], F.lit("@js:")))


def scored(candidates: DataFrame, keywords: list[str], name: str, author: str) -> DataFrame:
    """One row for each candidate and keyword, with sim_name and sim_author."""
    rows = candidates.withColumn("keyword", F.explode(F.array(*map(F.lit, keywords))))
    return rows.withColumn("sim_name", T.similarity(F.col("keyword"), F.coalesce(F.col(name), F.lit("")))).withColumn(
        "sim_author", T.similarity(F.col("keyword"), F.coalesce(F.col(author), F.lit("")))
    )


def ranked(rows: DataFrame, by: list[str], order: list[Column], index: str = "rank") -> DataFrame:
    """rows with 1, 2, .. in order for each value of `by` (never null), whatever the size of a group.

    Rows are dealt by ranges of (by, order), so a great group is sorted by many tasks; a row's number is its place in its
    range and the rows of its group in the ranges before, of which there is one count a range and group.
    """
    at = cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    ranges = at.groupBy(*by, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    ahead = F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(*by, "__part", "__first", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    numbered = at.withColumn("__part", part).join(F.broadcast(ranges), [*by, "__part"])  # ranges and groups, not rows
    return numbered.withColumn(index, (F.col("__at") - F.col("__first") + F.col("__ahead") + 1).cast("int")).drop("__at", "__part", "__first", "__ahead")


def ranked_search(candidates: DataFrame, keywords: list[str], name: str, author: str, tiebreak: list[str], filtered: bool = True, limit: int = 0) -> DataFrame:
    """candidates with keyword, similarity, by_author and rank, best first per keyword.

    Per keyword, the weights of all similarities decide whether names or authors are meant (authors if their sum is
    greater). Rows above THRESHOLD stay; if there are none, or unfiltered, all rows above 0 do. Order: similarity down, the
    other field up, then `tiebreak`. limit 0: all.
    """
    rows = scored(candidates, keywords, name, author)
    weight = lambda c: F.round(F.sum(T.match_weight(F.col(c), F.col("keyword"))), 6)
    modes = rows.groupBy("keyword").agg(
        (weight("sim_name") < weight("sim_author")).alias("by_author"),
        F.bool_or(F.col("sim_name") > THRESHOLD).alias("name_hit"),
        F.bool_or(F.col("sim_author") > THRESHOLD).alias("author_hit"),
    )
    rows = rows.join(F.broadcast(modes), "keyword")  # one row a keyword
    similarity = F.when(F.col("by_author"), F.col("sim_author")).otherwise(F.col("sim_name"))
    hit = F.when(F.col("by_author"), F.col("author_hit")).otherwise(F.col("name_hit"))
    least = F.when(hit & F.lit(filtered), F.lit(THRESHOLD)).otherwise(F.lit(0.0))
    kept = rows.withColumn("similarity", similarity).where(F.col("similarity") > least)
    second = F.when(F.col("by_author"), F.col(name)).otherwise(F.col(author))
    kept = kept.withColumn("__second", second).drop("sim_name", "sim_author", "name_hit", "author_hit")
    order = [F.col("similarity").desc(), F.col("__second").asc(), *map(F.col, tiebreak)]
    if not limit:
        return ranked(kept, ["keyword"], order).drop("__second")
    best = kept.withColumn("rank", F.row_number().over(W.partitionBy("keyword").orderBy(*order)))  # each task keeps its best
    return best.where(F.col("rank") <= limit).drop("__second")


def limit_per_source(rows: DataFrame, source: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each source, in order; n 0: all."""
    if not n:
        return rows
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*source).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def capped_limit(asked: int | None, most: int) -> int:
    """How many results a caller gets who asks for `asked`: at most `most`, if that is above 0; 0 (all) if nothing above 0 is left."""
    if asked is None:
        return 0
    return max(0, min(asked, most) if most > 0 else asked)


def suggestions(names: DataFrame, column: str, prefix: str, n: int = 10) -> DataFrame:
    """The first n names that begin with a prefix; a blank prefix suggests nothing."""
    if not prefix.strip():
        return names.select(column).limit(0)
    return names.where(F.col(column).startswith(prefix)).select(column).distinct().orderBy(column).limit(n)


def suggestion_index(names: DataFrame, column: str, longest: int = 8, n: int = 10) -> DataFrame:
    """(prefix, rank, column): for each prefix of up to `longest` characters that some name has, its first n names. Names are taken
    once each; a row for each name and length is ranked within its prefix, where every task keeps its best n only."""
    known = names.where(F.col(column).isNotNull()).select(column).distinct()
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length(column)))
    keyed = known.where(F.char_length(column) > 0).select(F.explode(lengths).alias("__k"), column).select(F.expr(f"left(`{column}`, __k)").alias("prefix"), column)
    return keyed.withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy(column))).where(F.col("rank") <= n).select("prefix", "rank", column)


def suggestions_for(requests: DataFrame, prefix: str, names: DataFrame, column: str, longest: int = 8, n: int = 10) -> DataFrame:
    """(requests..., rank, column): the first n names for the prefix of each request, by suggestions(); requests without any have no
    row. Prefixes meet the index by an equal join; those longer than `longest` meet the names that share their beginning."""
    index = suggestion_index(names, column, longest, n)
    asked = requests.where(F.trim(prefix) != "")
    size = F.char_length(prefix)
    short = asked.where(size <= longest).join(index.withColumnRenamed("prefix", "__p"), F.col(prefix) == F.col("__p")).drop("__p")
    known = names.where(F.char_length(column) > longest).select(column).distinct().withColumn("__p", F.expr(f"left(`{column}`, {longest})"))
    far = asked.where(size > longest).select(prefix).distinct().withColumn("__p", F.expr(f"left(`{prefix}`, {longest})"))
    met = far.join(known, "__p").where(F.col(column).startswith(F.col(prefix)))
    best = met.withColumn("rank", F.row_number().over(W.partitionBy(prefix).orderBy(column))).where(F.col("rank") <= n).select(prefix, "rank", column)
    return short.unionByName(asked.where(size > longest).join(best, prefix))


def suggestions_from_json(payloads: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Column `suggestions`: the first n of g[].q; malformed payloads have none."""
    parsed = F.from_json(F.col(column), "g array<struct<q string>>")
    return payloads.withColumn("suggestions", F.slice(F.coalesce(F.transform(parsed["g"], lambda g: g["q"]), F.array().cast("array<string>")), 1, n))
