"""Whitening against numpy's eigenvectors of the whole covariance, and the Lanczos core on matrices of every kind."""

import numpy as np
import pytest

from quire.llm import whiten

SF = "/root/testdata/sf0.001"


def brute(rows, k=4):
    """{(key, component): (n, deviation, whitened)} and the shares."""
    width = max((len(v) for _, v in rows), default=0)
    x = [(key, tuple([*np.floor(np.array(v, dtype=float) * 256).astype(int).tolist(), *[0] * (width - len(v))])) for key, v in rows]
    own = sorted({v for _, v in x})
    n, sums = len(own), [sum(c) for c in zip(*own, strict=True)]
    c = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in own], dtype=float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    values = values[values > 1e-9 * values.sum()]
    out = []
    for key, v in x:
        d = [n * a - s for a, s in zip(v, sums, strict=True)]
        out += [(key, j + 1, n, sum(a * a for a in d), float(np.array(d, dtype=float) / n @ vectors[:, j] / values[j] ** 0.5)) for j in range(len(values))]
    return out, values / np.trace(c.T @ c / n)


def agrees(got, want, shares):
    by = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[1], r[3], abs(r[4])))
    got, want = by([(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got]), by(want)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for j in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == j]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert all(abs(r[5] / shares[r[1] - 1] - 1) < 1e-9 for r in got)


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    got = whiten.op11_whiten(spark, SF).collect()
    agrees(got, *brute(rows))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.5, 0.0]), (1, [1.0, 0.5, 0.0]), (2, [1.0, 0.5, 0.0]), (None, [0.25, -3.0, 1.0]), (3, [7.0]), (4, []), (5, [-0.0, 0.001, 2.0]), (6, [0.5, 0.5, 0.5])]
    bad = [(7, None), (8, [nan, 1.0, 1.0]), (9, [1.0, None, 1.0]), (10, [1.0, inf, 1.0])]
    made = spark.createDataFrame([(*r, 5, "x") for r in rows + bad], "vec_id long, embedding array<double>, n int, component string")
    got = whiten.whiten(made).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    agrees(got, *brute(rows))
    for few in ([], bad, rows[:3], rows[5:6]):  # no vector, none that is sound, one distinct vector, one empty vector
        assert whiten.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2**40 + k), float(k * k)]) for k in range(9)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want, _ = brute(rows)
    assert sorted({(r["vec_id"], r["deviation"]) for r in got}) == sorted({(r[0], r[3]) for r in want})
    huge = whiten.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 3} == {2**63 - 1}


@pytest.mark.parametrize("size, rank, block, basis", [(64, 64, 8, 512), (200, 5, 8, 512), (3, 3, 8, 512), (12, 1, 4, 512), (1, 1, 8, 512), (300, 300, 4, 48), (30, 30, 1, 512)])
def test_lanczos(size, rank, block, basis):
    r = np.random.default_rng(size + rank)
    x = r.standard_normal((2000, rank)) @ r.standard_normal((rank, size))
    c = x.T @ x / len(x)
    calls = []
    values, vectors = whiten.block_lanczos(lambda q: (calls.append(q.shape[1]), c @ q)[1], size, 4, np.trace(c), block, basis)
    want = np.linalg.eigvalsh(c)[::-1][:4]
    assert np.allclose(values[: min(rank, 4)], want[: min(rank, 4)], rtol=1e-9)
    assert np.linalg.norm(c @ vectors - vectors * values, axis=0).max() < 1e-9 * want[0]
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)
    if rank == 5:
        assert len(calls) <= 3  # a breakdown ends it where the trace leaves nothing


def test_equal_eigenvalues():
    c = np.diag([3.0, 3.0, 3.0, 2.0, 2.0, *[1.0] * 40])
    values, vectors = whiten.block_lanczos(lambda q: c @ q, 45, 4, np.trace(c), block=2)
    assert np.allclose(values, [3, 3, 3, 2]) and np.linalg.norm(c @ vectors - vectors * values) < 1e-10
