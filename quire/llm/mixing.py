"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source lie on a line, its documents in the order of a seeded digest of id and text. The line is cut into blocks of equal
length. The target of a source fixes exactly how many words and so how many blocks it gives (all blocks once for each
whole pass, and as many of a permuted list as the rest needs, the last one cut short). A tree splits these quotas among
the output shards: a node deals the shards of its left half a sample without replacement of its blocks, and the counts by
source of that sample are multivariate hypergeometric. Each shard then takes its next blocks of every source's permuted
list, so shards are disjoint, and orders its pieces by a seeded digest.

All of it is DataFrame code. The prefix sums that place documents on the lines are made by slices of the digest, so a
source that holds most rows is spread over many tasks. Blocks and shards are bounded by parameters, not by the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_counted, n_words, staged, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
SEED = "quire"
N_BLOCKS = 4096
N_SHARDS = 16
ROWS_PER_SLICE = 20_000


def _digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """sources (source, source_size) with rank, weight and target.

    Weights go by rank (code points, null last) in turn. Sources are filled by weight to `share` of all words, each to
    `most` times its own at the most; the level is the largest of (rest / weight of the rest) over the sources in the order
    in which they fill up.
    """
    own = F.col("source_size") * most
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    order = W.orderBy(own / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ranked.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum(own).over(before), F.lit(0))) / F.sum("weight").over(rest))
    return level.withColumn("target", F.least(own.cast("double"), F.col("weight") * F.max("level").over(every))).drop("level")


def drawn_blocks(targets: DataFrame, block: Column, seed: str = SEED) -> DataFrame:
    """(rank, block, copy, nth, taken): the blocks that each source gives, nth in its permuted list, with their words.

    block: words of a block. Over all sources there are about N_BLOCKS * SHARE rows, whatever the data.
    """
    size, quota = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    blocks = (
        targets.where(size > 0)
        .select("rank", "source_size", quota.alias("quota"), block.alias("block_words"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("quota") / size))))
        .withColumn("left", F.col("quota") - F.col("copy") * size)
        .where("left > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(size / F.col("block_words")) - 1)))
        .withColumn("words", F.least(F.col("block_words"), size - F.col("block") * F.col("block_words")))
        .withColumn("mixed", _digest(seed, F.col("rank"), F.col("copy"), F.col("block")))
    )
    one = W.partitionBy("rank", "copy").orderBy("mixed", "block").rowsBetween(W.unboundedPreceding, -1)
    taken = F.least(F.col("words"), F.col("left") - F.coalesce(F.sum("words").over(one), F.lit(0)))
    drawn = blocks.withColumn("taken", taken).where("taken > 0")
    return drawn.withColumn("nth", F.row_number().over(W.partitionBy("rank").orderBy("copy", "mixed", "block")) - 1).select("rank", "block", "copy", "nth", "taken")


def shard_quotas(quotas: DataFrame, n_shards: int, seed: str = SEED) -> DataFrame:
    """(shard, rank, n): how many blocks of each source a shard gets, if any; quotas: (rank, n).

    The splitting tree, level by level. A node's left half gets its share of the node's blocks, those of the least digests:
    a sample without replacement, so its counts by source are multivariate hypergeometric.
    """
    at = quotas.where("n > 0").select("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("i"), F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"))
    for _ in range(math.ceil(math.log2(max(1, n_shards)))):
        node = W.partitionBy("lo", "hi")
        place = F.row_number().over(node.orderBy(_digest(seed, F.col("lo"), F.col("hi"), F.col("rank"), F.col("i")), "rank", "i"))
        at = at.withColumns({"place": place, "all": F.count("*").over(node), "mid": F.expr("cast((lo + hi) div 2 as int)")})
        left = F.col("place") <= F.expr("(all * (mid - lo)) div (hi - lo)")
        inner = F.col("hi") - F.col("lo") > 1
        at = at.select("rank", "i", F.when(inner & ~left, F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(inner & left, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    return at.groupBy(F.col("lo").alias("shard"), "rank").agg(F.count("*").alias("n"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_TIMES, n_blocks: int = N_BLOCKS, n_shards: int = N_SHARDS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of a mix of `docs` (doc_id, text, source).

    documents: doc_id, source, size, source_size, target, row (numbers the rows of a source; equal doc_ids stay apart).
    pieces: row, rank (of the source), doc_id, shard, place (the order within the shard), copy, start and n_words: the
    words from `start` on, n_words of them, go to that place. Sorting a shard by place shuffles it.

    Null and blank texts have size 0 and give no piece; a null source is a source of its own, the last. Repeated rows are
    documents of their own. Without any word all targets are 0. Empty in, empty out; other columns are ignored.
    """
    sized = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _digest(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")))).alias("mixed")), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(by_source, weights, share, most), "targets")
    total = targets.agg(F.greatest(F.lit(1), F.ceil(F.sum("source_size") / n_blocks)).cast("long").alias("block_words"))
    targets = targets.crossJoin(F.broadcast(total))  # one row

    digits = min(6, max(1, math.ceil(math.log(max(1, sized.count() / ROWS_PER_SLICE), 16)) + 1))
    placed = sized.withColumn("slice", F.left("mixed", F.lit(digits)))
    slices = placed.groupBy("source", "slice").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    ahead = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_ahead"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"))
    slices = slices.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, slices.source.eqNullSafe(targets.source)).select(slices.source, "slice", "n_ahead", "rows_ahead", "rank", "source_size", "target", "block_words")

    inner = W.partitionBy("source", "slice").orderBy("mixed", "doc_id", "size")
    own = placed.select(
        "doc_id",
        "source",
        "slice",
        "size",
        F.row_number().over(inner).alias("nth_row"),
        F.coalesce(F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("from"),
    )
    # one row a slice on the right; the left side is spread over slices
    documents = own.join(slices, own.source.eqNullSafe(slices.source) & (own.slice == slices.slice)).select(
        "doc_id", own.source, "size", "source_size", "target", "rank", "block_words", (F.col("rows_ahead") + F.col("nth_row")).alias("row"), (F.col("n_ahead") + F.col("from")).alias("from")
    )

    blocks = staged(drawn_blocks(targets, F.col("block_words"), seed), "blocks")
    quotas = shard_quotas(blocks.groupBy("rank").agg(F.count("*").alias("n")), n_shards, seed)
    runs = quotas.withColumn("past", F.sum("n").over(W.partitionBy("rank").orderBy("shard"))).withColumn("first", F.col("past") - F.col("n")).where("n > 0").drop("n")
    dealt = blocks.join(F.broadcast(runs) if at_most_rows(n_shards, targets) else runs, "rank").where("nth >= first and nth < past").drop("first", "past", "nth")

    parts = documents.where("size > 0").select(
        "doc_id", "rank", "row", "size", "from", "block_words", F.explode(F.sequence(F.expr("`from` div block_words"), F.expr("(`from` + size - 1) div block_words"))).alias("block")
    )
    at = F.col("block") * F.col("block_words")
    start, end = F.greatest(F.col("from"), at), F.least(F.col("from") + F.col("size"), at + F.col("taken"))
    pieces = (
        join_counted(parts, dealt, ["rank", "block"], rows=100_000)
        .withColumn("n_words", end - start)
        .where("n_words > 0")
        .select("row", "rank", "doc_id", "shard", _digest(seed, F.col("copy"), F.col("rank"), F.col("row"), F.col("block")).alias("place"), "copy", (start - F.col("from")).alias("start"), "n_words")
    )
    return documents.drop("from", "block_words"), pieces


def at_most_rows(n_shards: int, targets: DataFrame, most: int = 200_000) -> bool:
    return n_shards * targets.count() <= most


def mixed_texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(shard, place, doc_id, text): the mix itself, one row for each piece, sorted within its shard.

    docs must have each doc_id once. The words of a piece are joined by one space.
    """
    from .common import words

    cut = F.slice(words(F.col("text")), (F.col("start") + 1).cast("int"), F.col("n_words").cast("int"))
    made = pieces.join(docs.select("doc_id", "text"), "doc_id").select("shard", "place", "doc_id", F.concat_ws(" ", cut).alias("text"))
    return made.repartition("shard", F.substring("place", 1, 1)).sortWithinPartitions("shard", "place")


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_pieces, shards (where its pieces go: numbers in order, joined by commas;
    empty without pieces), one row for each row of docs."""
    documents, pieces = mix_sources(docs, **how)
    shards = F.concat_ws(",", F.array_sort(F.collect_set("shard")).cast("array<string>"))
    taken = pieces.groupBy("rank", "row").agg(F.sum("n_words").alias("taken"), F.count("*").alias("n_pieces"), shards.alias("shards"))
    made = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_pieces")]
    return documents.join(taken, ["rank", "row"], "left").select("doc_id", "size", "source_size", "target", *made, F.coalesce("shards", F.lit("")).alias("shards"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


def _sql_level(k: int) -> str:
    """One level of the tree: node (lo, hi) of each block after k + 1 cuts."""
    return f"""tree{k + 1} AS (
  SELECT rank, i, CASE WHEN hi - lo > 1 AND place > own * (mid - lo) // (hi - lo) THEN mid ELSE lo END lo,
         CASE WHEN hi - lo > 1 AND place <= own * (mid - lo) // (hi - lo) THEN mid ELSE hi END hi
  FROM (SELECT *, (lo + hi) // 2 mid, count(*) OVER (PARTITION BY lo, hi) own,
               row_number() OVER (PARTITION BY lo, hi ORDER BY md5('{SEED}|' || lo || '|' || hi || '|' || rank || '|' || i), rank, i) place FROM tree{k}))"""


_LEVELS = math.ceil(math.log2(N_SHARDS))
OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) mixed FROM documents),
src AS (SELECT source, sum(size)::BIGINT source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) rank FROM src),
weighed AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] weight FROM ranked),
lev AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size * 2 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lvl FROM weighed),
tgt AS (
  SELECT source, source_size, rank, least((source_size * 2)::DOUBLE, weight * max(lvl) OVER ()) target,
         greatest(1, ceil(sum(source_size) OVER () / {N_BLOCKS}))::BIGINT bw FROM lev),
blocks AS (
  SELECT *, least(bw, source_size - block * bw) words, md5('{SEED}|' || rank || '|' || copy || '|' || block) mixed FROM (
    SELECT *, unnest(range(0, ceil(source_size / bw)::BIGINT)) block FROM (
      SELECT *, floor(target + 0.5)::BIGINT - copy * source_size rest FROM (
        SELECT *, unnest([0, 1, 2]) copy FROM tgt WHERE source_size > 0)) WHERE rest > 0)),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY rank ORDER BY copy, mixed, block) nth FROM (
    SELECT rank, block, copy, mixed, least(words, rest - coalesce(sum(words) OVER (PARTITION BY rank, copy ORDER BY mixed, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) taken FROM blocks)
  WHERE taken > 0),
tree0 AS (SELECT rank, nth i, 0 lo, {N_SHARDS} hi FROM drawn),
{", ".join(map(_sql_level, range(_LEVELS)))},
runs AS (SELECT rank, lo shard, n, sum(n) OVER (PARTITION BY rank ORDER BY lo) past FROM (SELECT rank, lo, count(*) n FROM tree{_LEVELS} GROUP BY rank, lo)),
dealt AS (SELECT d.rank, block, taken, shard FROM drawn d JOIN runs r ON d.rank = r.rank AND nth > past - n AND nth <= past),
lines AS (
  SELECT s.*, t.source_size, t.target, t.rank, t.bw, row_number() OVER () rid,
         coalesce(sum(size) OVER (PARTITION BY rank ORDER BY mixed, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT beg
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
pieces AS (
  SELECT rid, sum(n_words)::BIGINT taken, count(*) n_pieces, array_to_string(list_sort(list(DISTINCT shard)), ',') shards
  FROM (SELECT rid, shard, least(beg + size, d.block * bw + taken) - greatest(beg, d.block * bw) n_words
        FROM (SELECT *, unnest(range(beg // bw, (beg + size - 1) // bw + 1)) block FROM lines WHERE size > 0) p
        JOIN dealt d ON p.rank = d.rank AND p.block = d.block) WHERE n_words > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT taken, coalesce(n_pieces, 0)::BIGINT n_pieces, coalesce(shards, '') shards FROM lines LEFT JOIN pieces USING (rid)
"""
