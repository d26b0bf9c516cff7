"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over SPAN consecutive tokens that ignores some positions. Each mask gives every position of a text a hash
of the tokens that it selects; equal hashes of a benchmark item and a document are hits, also where a substitution falls on
ignored positions. A hit places the item over the document (document start = hit - position in the item). The placed texts
are then compared token by token around the hits: a run of the overlap with at least LEAST tokens, of which at most SLACK
differ, confirms the leak. Items of fewer than SPAN tokens have no seed: they hit, and count, only where they stand whole
and without a difference.

Everything is DataFrame code. Token hashes are made once per text; masks are combinations of them. The benchmark's hashes
are broadcast when they were counted to be small; beyond that both sides are joined by shuffle on the hash. Hits are
reduced to one row for each document, item and placement before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, join_counted, join_wide, staged, table, words

SPAN = 10
#: The selected positions (1) of each mask. Every pair of positions is ignored by one of them, so any ten tokens with up to two
#: substitutions keep one mask whole: one in five, at every length from ten on.
MASKS = ("0101110100", "0110101010", "1010011100", "1001101001", "0011010011", "1100000111")
LEAST = 13
SLACK = 0.2
#: Rows of benchmark hashes that are broadcast at most (16 bytes each); so many rows and array values of placements and items.
BROADCAST = 1_000_000


def token_hashes(text):
    """array<bigint>: hashes of the words in lower case without marks at their ends; words of marks only go."""
    bare = F.regexp_replace(F.lower(text), r"(?<![^\x20\x09-\x0D])[\p{P}\p{S}]+|[\p{P}\p{S}]+(?![^\x20\x09-\x0D])", "")
    return F.transform(words(bare), lambda w: F.xxhash64(w))


def _seeds(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """tokens (keep..., h: array<bigint>) to one row for each position and mask: keep..., pos (from 0), seed."""
    n = F.size("h") - SPAN + 1
    columns = [F.slice("h", k + 1, F.greatest(n, F.lit(0))).alias(f"t{k}") for k in range(SPAN)]
    spans = F.posexplode(F.when(n > 0, F.arrays_zip(*columns)))
    at = tokens.select(*keep, spans.alias("pos", "t"))
    hashes = [F.xxhash64(F.lit(i), *(F.col(f"t.t{k}") for k in range(SPAN) if mask[k] == "1")) for i, mask in enumerate(MASKS)]
    return at.select(*keep, "pos", F.explode(F.array(*hashes)).alias("seed"))


def _whole(tokens: DataFrame, keep: list[str], n: int) -> DataFrame:
    """tokens to one row for each run of n tokens, as _seeds gives them: keep..., pos, seed (of the run and n)."""
    last = F.size("h") - n
    runs = F.posexplode(F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice("h", k + 1, n))))
    return tokens.select(*keep, runs.alias("pos", "t")).select(*keep, "pos", F.xxhash64(F.lit(-n), "t").alias("seed"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, slack: float = SLACK) -> DataFrame:
    """doc_id, item_id, start, n_tokens, n_equal, n_item: passages of benchmark items (item_id, text) in docs (doc_id, text).

    One row for each item in a document: the placement with most equal tokens (ties: the first). start counts the
    document's tokens from 0; n_tokens is the length of the confirmed run, n_equal the equal tokens in it, n_item the length
    of the item. The run is the one with the highest score (see _BEST_RUN) among those long enough. An item shorter than
    `least` must stand in the document whole, one of fewer than SPAN tokens without a difference. Null and blank texts have no tokens. Rows of equal doc_id are searched each and reported
    as one, those without a doc_id too. Other columns are ignored. Empty in, empty out.
    """
    items = staged(benchmark.select("item_id", token_hashes(F.coalesce(F.col("text"), F.lit(""))).alias("h")).where(F.size("h") > 0).distinct(), "items")
    short = sorted(r["n"] for r in items.where(F.size("h") < SPAN).select(F.size("h").alias("n")).distinct().collect())  # less than SPAN rows
    theirs = _seeds(items, ["item_id"])
    for n in short:
        theirs = theirs.unionByName(_whole(items.where(F.size("h") == n), ["item_id"], n))
    theirs = theirs.select("item_id", F.col("pos").alias("item_pos"), "seed")
    small = at_most(theirs, BROADCAST)
    tokens = docs.select("doc_id", token_hashes(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    mine = _seeds(tokens, ["doc_id"])
    for n in short:
        mine = mine.unionByName(_whole(tokens, ["doc_id"], n))
    hits = mine.join(F.broadcast(theirs) if small else theirs, "seed")
    placed = staged(hits.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "placed")

    # the few documents with hits meet their tokens again, placements packed by document
    by_doc = placed.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))
    return _confirmed(docs, by_doc, items, least, slack)


def _confirmed(docs: DataFrame, by_doc: DataFrame, items: DataFrame, least: int, slack: float) -> DataFrame:
    # rows without a doc_id are searched as well
    by_doc = by_doc.withColumnRenamed("doc_id", "hit_id")
    found = docs.select("doc_id", "text").join(F.broadcast(by_doc) if at_most(by_doc, BROADCAST, F.size("shifts")) else by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")))
    found = found.select("doc_id", token_hashes(F.coalesce(F.col("text"), F.lit(""))).alias("d"), "item_id", "shifts")
    found = join_counted(found, items.withColumnRenamed("h", "i"), ["item_id"], rows=BROADCAST, values=F.size("i"))
    found = found.withColumn("n_item", F.size("i")).withColumn("need", F.least(F.lit(least), F.col("n_item")))
    # all placements of an item in one expression: the tokens are there once
    best_run = _BEST_RUN.format(slack=round(slack * _ONE), one=_ONE)
    runs = F.expr(f"transform(shifts, s -> named_struct('shift', s, 'run', transform(array({_EQUAL}), equal -> {best_run})[0]))")
    good = "r -> r.run.n >= need and (n_item >= {span} or r.run.equal = n_item)".format(span=SPAN)
    best = F.expr(f"array_max(transform(filter(runs, {good}), r -> named_struct('equal', r.run.equal, 'back', -r.shift, 'start', r.shift + r.run.at, 'n_tokens', r.run.n)))")
    return (
        found.select("doc_id", "item_id", "n_item", "need", runs.alias("runs"))
        .select("doc_id", "item_id", "n_item", best.alias("b"))
        .where(F.col("b").isNotNull())
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct(F.col("b.start").alias("start"), F.col("b.n_tokens").alias("n_tokens"), F.col("b.equal").alias("n_equal"), "n_item"), F.struct("b.equal", "b.back")).alias("best"))
        .select("doc_id", "item_id", "best.*")
    )


#: For each token of the item, whether it stands at its place in the document; null beyond the document's ends.
_EQUAL = "transform(sequence(0, size(i) - 1), k -> if(k + s >= 0 and k + s < size(d), if(get(d, k + s) = get(i, k), 1, 0), null))"
_ONE = 1_000_000
#: Of the runs with at least `need` tokens of which at most a share `slack` differ, the one with the highest score, where an
#: equal token scores slack and another slack - 1 (in millionths, so that sums are exact); n is 0 where there is none. A run
#: scores its last prefix sum less the one before its start: o is the least such sum so far that lies `need` tokens back, l
#: the latest one. Ties: the run that ends first, the longest of those. Tokens beyond the document's ends belong to no run.
_BEST_RUN = """aggregate(transform(equal, (e, k) -> named_struct('e', e, 'k', k, 'back', if(k >= need, get(equal, k - need), null))),
  named_struct('n', 0, 's', 0L, 'q', 0, 'l', named_struct('at', 0, 's', 0L, 'q', 0), 'o', named_struct('at', 0, 's', 0L, 'q', 0), 'best', named_struct('score', -1L, 'at', 0, 'n', 0, 'equal', 0)),
  (a, x) -> if(x.e is null, a, transform(transform(array(named_struct('n', a.n + 1, 's', a.s + {slack}L - if(x.e = 1, 0L, {one}L), 'q', a.q + x.e, 'l',
      if(a.n = 0, named_struct('at', x.k, 's', 0L, 'q', 0), if(a.n < need, a.l, named_struct('at', a.l.at + 1, 's', a.l.s + {slack}L - if(x.back = 1, 0L, {one}L), 'q', a.l.q + x.back))))),
    c -> named_struct('n', c.n, 's', c.s, 'q', c.q, 'l', c.l, 'o', if(a.n = 0 or c.l.s < a.o.s, c.l, a.o))),
    c -> named_struct('n', c.n, 's', c.s, 'q', c.q, 'l', c.l, 'o', c.o, 'best', if(c.n >= need and c.s - c.o.s > a.best.score,
      named_struct('score', c.s - c.o.s, 'at', c.o.at, 'n', x.k + 1 - c.o.at, 'equal', c.q - c.o.q), a.best)))[0]),
  a -> a.best)"""


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a passage of the benchmark, whatever their doc_id."""
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    bad = find_leaks(keyed.select(F.col("__text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__text")).distinct()
    return join_wide(keyed, staged(bad, "bad"), ["__text"], "left_anti", rows=500_000).select(*docs.columns)


def op1_find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
