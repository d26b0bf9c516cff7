"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into segments. With mean m and deviation s = |x - m| of a segment of length n, the inner product over it is
at most n m m' + s s', as the distance over it is at least n (m - m')^2 + (s - s')^2. These bounds are taken coarse to
fine (LEVELS segments); pairs whose bound falls below the query's k-th score so far are dropped, and only the rest get
their exact score. Nothing is approximate: a bound equal to the k-th score survives, as a smaller id may win the tie.

Candidates stay where they are read. Queries go out in waves of at most about WAVE vectors, the proven bound of what is
broadcast; each task keeps k rows for a query, and the last ranking sees those only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SCALE = 256
TOP = 5
EVERY = 50
WAVE = 40_000
LEVELS = (4, 16)
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Up to this, products and sums of integers are exact in doubles.
EXACT = 2.0**53
LONG = 2**63 - 1


def scaled(vectors, width: int = 0) -> np.ndarray:
    """floor(SCALE * x) of each vector as whole doubles, shorter ones filled up with zeros."""
    width = max([width, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return np.floor(out * SCALE)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: sqrt(n) * mean of each segment, then the deviation of each; inner products of these rows are upper bounds."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    mean = np.stack([p.mean(axis=1) if p.shape[1] else np.zeros(len(x)) for p in parts], axis=1)
    dev = np.stack([np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, mean.T, strict=True)], axis=1)
    return np.concatenate([mean * np.sqrt([p.shape[1] for p in parts]), dev], axis=1)


class Best:
    """The k best candidates of each query so far; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.levels = [statistics(x, s) for s in LEVELS]
        self.score = np.full((len(ids), k), -np.inf)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.exact = 0

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        width = max(x.shape[1], self.x.shape[1])
        if x.shape[1] < width:
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        if self.x.shape[1] < width:
            self.x = np.pad(self.x, ((0, 0), (0, width - self.x.shape[1])))
            self.levels = [statistics(self.x, s) for s in LEVELS]
        theirs = [statistics(x, s) for s in LEVELS]
        for a in range(0, len(self.ids), QUERY_BLOCK):
            rows = slice(a, a + QUERY_BLOCK)
            least = self.score[rows, -1]
            own = self.ids[rows, None] == ids[None, :]
            alive = ~own
            if np.isfinite(least).any():
                for mine, other in zip(self.levels, theirs, strict=True):
                    bound = mine[rows] @ other.T
                    bound += np.abs(bound) * 1e-9 + 1e-6  # what rounding may take off
                    alive &= bound >= least[:, None]
            q, c = np.nonzero(alive)
            self.exact += len(q)
            if not len(q):
                continue
            if len(q) > 0.2 * alive.size:
                s = (self.x[rows] @ x.T)[q, c]
            else:
                s = np.einsum("ij,ij->i", self.x[rows][q], x[c])
            good = s >= least[q]
            if good.any():
                self.merge(a, q[good], ids[c[good]], s[good])

    def merge(self, a: int, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        rows = np.unique(q)
        old_q = np.repeat(rows, self.k)
        q, ids, s = np.concatenate([old_q, q]), np.concatenate([self.id[a + rows].ravel(), ids]), np.concatenate([self.score[a + rows].ravel(), s])
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        begin = np.searchsorted(q, rows)
        take = begin[:, None] + np.arange(self.k)[None, :]
        self.score[a + rows], self.id[a + rows] = s[take], ids[take]


def _whole(x: np.ndarray) -> list[list[int]]:
    return [[int(v) for v in row] for row in x]


def _exact_rows(q_ids, q, ids, x, k):
    """Top rows with whole numbers of any size, for vectors beyond what doubles hold; scores are held within 64 bits."""
    theirs = list(zip(ids.tolist(), _whole(x), strict=True))
    for qid, own in zip(q_ids.tolist(), _whole(q), strict=True):
        scores = [(-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(own, v, strict=False)))), i) for i, v in theirs if i != qid]
        for s, i in sorted(scores)[:k]:
            yield qid, i, -s


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the highest integer inner product with each query.

    Both have vec_id, embedding. Rows with a null id, a null embedding, or a null or non-finite component take no part.
    Rows of the query's own id are no candidates; a repeated query id is asked once, with its least vector; repeated
    candidates count each. Ties go to the smaller vec_id. Vectors of unequal length are filled up with zeros, so an empty
    vector scores 0 everywhere. Scores beyond 64 bits are held at the limits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    numbers = F.transform("embedding", lambda v: v.cast("double")).alias("embedding")
    candidates = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), numbers)
    asked = queries.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), numbers).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    waves = max(1, -(-asked.count() // wave))
    schema = "query_id long, vec_id long, score long"

    def wave_result(n: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == n).collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), scaled([r[1] for r in rows])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q = sent.value
            best, odd = Best(q_ids, q, k), []
            reach = float(np.abs(q).max(initial=0.0))
            for pdf in batches:
                for a in range(0, len(pdf), CANDIDATE_BLOCK):
                    part = pdf.iloc[a : a + CANDIDATE_BLOCK]
                    ids, x = part["vec_id"].to_numpy(), scaled(part["embedding"].to_list(), q.shape[1])
                    if float(np.abs(x).max(initial=0.0)) * reach * x.shape[1] >= EXACT:
                        odd += _exact_rows(q_ids, q, ids, x, k)
                    else:
                        best.offer(ids, x)
            there = np.isfinite(best.score)
            at = np.nonzero(there)[0]
            yield pd.DataFrame({"query_id": q_ids[at], "vec_id": best.id[there], "score": best.score[there].astype(np.int64)})
            for b in range(0, len(odd), 50_000):
                yield pd.DataFrame(odd[b : b + 50_000], columns=["query_id", "vec_id", "score"])

        return candidates.mapInPandas(run, schema)

    found = wave_result(0)
    for n in range(1, waves):
        found = found.unionByName(wave_result(n))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP7_SQL = f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INT rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= {TOP}
"""
