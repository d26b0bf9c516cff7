"""Whitened coordinates of vectors, by matrix-free block Lanczos.

The covariance of the vectors is never made. A pass over the data multiplies it with a block of directions: each task centres
its rows, X, and adds up XᵀXv; the sums have one row a dimension. Block Lanczos asks for such passes, keeps all directions
orthogonal to one another, and stops when the leading eigenvectors of its small matrix have residuals at the level of
rounding. A block that breaks down, as the space it spans is complete, goes on with fresh directions orthogonal to all before;
a basis that grows too large begins again from its best vectors.

Whole numbers stay exact: sums and deviations are integers of any size, and centring subtracts integers before it divides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

SCALE = 256
COMPONENTS = 4
#: Directions of a block, and of a basis before it begins again (times the dimension, the most that the driver keeps).
BLOCK, BASIS = 8, 512
#: Residual over the largest eigenvalue at which a component is done, and share of it below which an eigenvalue counts as 0.
DONE, ZERO = 1e-14, 1e-12
#: Runs that begin again from their best vectors; if the last one is not done to LEAST, that is an error.
RUNS, LEAST = 100, 1e-9
LONG = 2**63 - 1


class Fit(NamedTuple):
    """n vectors with their sums (whole numbers); components by row, their eigenvalues, their shares of the trace, and the
    largest entry by which the whitened covariance differs from the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def sound(embedding: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    return F.col(embedding).isNotNull() & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def stepped(embedding: str, width: int) -> Column:
    """floor(SCALE * c) of each entry; beyond 64 bits held at the limits. Shorter vectors are filled up with zeros."""
    scaled = F.transform(embedding, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(9.2e18)), F.lit(-9.2e18))).cast("long"))
    return F.slice(F.concat(scaled, F.array_repeat(F.lit(0).cast("long"), width)), 1, width)


def rows_of(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def scaled_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit numbers where they and the sums of their squares fit, else Python's."""
    reach = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    kind = np.int64 if reach * reach * max(1, x.shape[1]) < LONG else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, with one rounding."""
    return scaled_deviations(x, n, sums).astype(np.float64) / n


def _summed(fitted: DataFrame, width: int, columns: int, of_rows: Callable[[np.ndarray], np.ndarray], height: int | None = None) -> np.ndarray:
    """The sum over all rows of what of_rows gives for a batch of them: an array of `height` (the width) rows and so many columns."""
    high = width if height is None else height
    names = [f"y{k}" for k in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((high, columns)), False
        for batch in batches:
            total, some = total + of_rows(rows_of(batch.column(0), width)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(high, dtype=np.int32)), *map(pa.array, total.T)], ["dim", *names])

    made = fitted.mapInArrow(run, "dim int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((high, columns))
    for r in made.groupBy("dim").agg(*(F.sum(c).alias(c) for c in names)).collect():
        out[r["dim"]] = r[1:]
    return out


def whole_sums(fitted: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = rows_of(batch.column(0), width)
            fits = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * len(x) < LONG
            sums = [a + int(b) for a, b in zip(sums, x.astype(np.int64 if fits else object).sum(axis=0), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(width), -1], pa.int32()), pa.array([*map(str, sums), str(n)])], ["dim", "s"])

    made = fitted.mapInArrow(run, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["dim"]: int(r["s"]) for r in made.collect()}
    return found.pop(-1, 0), [found.get(k, 0) for k in range(width)]


def trace_of(fitted: DataFrame, width: int, n: int, sums: list[int]) -> float:
    """Trace of the covariance, from the exact deviations of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            d = scaled_deviations(rows_of(batch.column(0), width), n, sums)
            total += sum(map(int, (d * d).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array([total / n**3])], ["t"])

    return float(fitted.mapInArrow(run, "t double").agg(F.sum("t")).first()[0] or 0.0)


def orthogonal(block: np.ndarray, basis: np.ndarray, least: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(q, r): block less what lies in the basis is q @ r, with orthonormal q also orthogonal to the basis. Columns that break
    down, with nothing of their own above `least`, become fresh directions with a zero row in r; q is narrower when the space
    has no more of them."""
    size, wide = block.shape
    q, r = np.zeros((size, 0)), np.zeros((0, wide))
    left = block.copy()
    for k in range(wide):
        if basis.shape[1] + q.shape[1] >= size:
            break
        before = np.hstack([basis, q])
        v, row = left[:, k], np.zeros((1, wide))
        for _ in range(2):
            v = v - before @ (before.T @ v)
        norm = float(np.linalg.norm(v))
        fresh = norm <= least
        while fresh:
            v = random.standard_normal(size)
            for _ in range(3):
                v = v - before @ (before.T @ v)
            norm = float(np.linalg.norm(v))
            if norm > 1e-8:
                break
        v = v / norm
        if not fresh:
            row = (v @ left)[None, :]
            row[0, :k] = 0
            left = left - np.outer(v, row)
        q, r = np.hstack([q, v[:, None]]), np.vstack([r, row])
    return q, r


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], size: int, k: int, trace: float = float("inf"), block: int = BLOCK, basis: int = BASIS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors by column): the k largest eigenpairs of a symmetric matrix without negative ones that is known by its
    products with blocks. After a breakdown the residuals say nothing of the rest of the space: then what the trace leaves
    for it must be no more than the least value found."""
    random = np.random.default_rng(seed)
    k = min(k, size)
    start, _ = orthogonal(random.standard_normal((size, min(max(block, k), size))), np.zeros((size, 0)), 0.0, random)
    for run in range(RUNS):
        all_q, q = start, start
        t = np.zeros((0, 0))
        last = None  # couples the newest block with the one before it
        while True:
            made = times(q)
            w = made if last is None else made - all_q[:, -q.shape[1] - last.shape[1] : -q.shape[1]] @ last.T
            a = q.T @ w
            w = w - q @ a
            old = len(t)
            grown = np.zeros((old + len(a), old + len(a)))
            grown[:old, :old], grown[old:, old:] = t, (a + a.T) / 2
            if last is not None:
                grown[old:, old - last.shape[1] : old] = last
                grown[old - last.shape[1] : old, old:] = last.T
            t = grown
            values, s = np.linalg.eigh(t)
            values, s = values[::-1][:k], s[:, ::-1][:, :k]
            top = max(float(abs(values[0])), np.finfo(float).tiny)
            nxt, r = orthogonal(w, all_q, 1e-13 * top, random)
            residual = np.linalg.norm(r @ s[-q.shape[1] :], axis=0) if len(r) else np.zeros(len(values))
            done = not nxt.shape[1] or residual.max(initial=0) <= DONE * top and (r.any() or trace - np.trace(t) <= max(values[-1], ZERO * trace))
            if done or len(t) + nxt.shape[1] > max(basis, 4 * block):
                break
            all_q, q, last = np.hstack([all_q, nxt]), nxt, r
        vectors = all_q @ s
        if done or run == RUNS - 1 and residual.max() <= LEAST * top:
            return values, vectors
        more = all_q @ np.linalg.eigh(t)[1][:, ::-1][:, : start.shape[1]]
        start, _ = orthogonal(more, np.zeros((size, 0)), 0.0, random)
    raise ArithmeticError(f"no convergence: residual {residual.max() / top:.1e}; a larger basis is needed")


def fit(fitted: DataFrame, width: int, k: int = COMPONENTS) -> Fit:
    """The leading components of the rows (one column, x) of `fitted`."""
    n, sums = whole_sums(fitted, width)
    trace = trace_of(fitted, width, n, sums) if n else 0.0
    if not trace:
        return Fit(n, sums, np.zeros((0, width)), np.zeros(0), np.zeros(0), 0.0)

    def times(q: np.ndarray) -> np.ndarray:
        def of_rows(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return _summed(fitted, width, q.shape[1], of_rows) / n

    values, vectors = block_lanczos(times, width, k, trace)
    good = values > ZERO * trace
    values, vectors = values[good], vectors[:, good]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    vectors = vectors * signs
    to = vectors / np.sqrt(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ to
        return np.vstack([w.T @ w, w.sum(axis=0)])

    m = len(values)
    moments = _summed(fitted, width, m, whitened, m + 1) / n
    error = moments[:m] - np.outer(moments[m], moments[m]) - np.eye(m)
    return Fit(n, sums, vectors.T, values, values / trace, float(np.abs(error).max()))


def whiten(vectors: DataFrame, k: int = COMPONENTS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): the coordinates of each row in the k leading
    components, each of variance 1.

    Entries are taken in whole steps of 1 / SCALE. Rows with a null vector, or with null or non-finite entries, take no part.
    The fit is over the distinct vectors, so repeated rows and hot vectors count once; each row gets its own coordinates, also
    if its key is null or repeated. Shorter vectors are filled up with zeros. Components whose variance is 0 (all of them if
    there are fewer than two distinct vectors) have no coordinates and are left out, so that a table can give no rows; equal
    variances are ties, of which any orthogonal directions are right. Directions have their largest entry positive. deviation
    is the sum over the dimensions of (n * x - sum) ** 2, held at the largest 64-bit number. Other columns are dropped, whatever
    their names. The distinct vectors are written to the shared folder once; what goes to the driver is a row a dimension.
    """
    bare = vectors.where(sound(embedding)).select(F.col(key).alias("__key"), F.col(embedding).alias("__v"))
    width = bare.agg(F.max(F.size("__v"))).first()[0] or 0
    x = bare.select("__key", stepped("__v", width).alias("x"))
    kind = vectors.schema[key].dataType.simpleString()
    fitted = staged(x.groupBy("x").agg(F.lit(1).alias("__one")).select("x"), "distinct")
    made = fit(fitted, width, k) if width else Fit(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    n, sums, to, m = made.n, made.sums, made.vectors.T / np.sqrt(made.values), len(made.values)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = scaled_deviations(rows_of(batch.column(1), width), n, sums)
            w = (d.astype(np.float64) / n) @ to
            rows, at = len(w), np.repeat(np.arange(len(w)), m)
            deviation = np.array([min(LONG, int(v)) for v in (d * d).sum(axis=1)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)), pa.array(np.full(rows * m, n)), pa.array(deviation[at]), pa.array(w.ravel()), pa.array(np.tile(made.explained, rows)), pa.array(np.full(rows * m, made.identity_error))], names
            )

    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return (x if m else x.limit(0)).mapInArrow(run, schema)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
