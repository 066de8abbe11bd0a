import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import whitening as W

RNG = np.random.default_rng(5)


def matrices():
    a = RNG.standard_normal((40, 12))
    q, _ = np.linalg.qr(RNG.standard_normal((20, 20)))
    yield a.T @ a
    yield np.diag([5.0, 5.0, 5.0, 2.0, 2.0, 1.0])
    yield np.eye(7) * 1e-9
    yield (q * np.array([1.0] * 8 + [1 - 1e-13] * 4 + [1e-4] * 8)) @ q.T
    yield np.ones((9, 9)) * 1e12
    yield np.array([[3.0]])
    yield np.array([[2.0, 1.0], [1.0, 2.0]])
    glued = np.kron(np.eye(3), np.diag(np.ones(6), 1) + np.diag(np.ones(6), -1) + np.diag(np.abs(np.arange(-3.0, 4))))
    yield glued + np.eye(21) * 5


@pytest.mark.parametrize("matrix", list(matrices()), ids=range(8))
def test_eigenpairs_equal_a_dense_solver(matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = W.leading(matrix, 16)
    known = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    known = known[: min(16, len(matrix))]
    known = known[known > W.RANK * 10 * known[0]]
    size = np.abs(matrix).max()
    assert len(values) >= len(known) and np.allclose(values[: len(known)], known, rtol=1e-12, atol=1e-13 * size)
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
    assert np.abs(vectors @ matrix - values[:, None] * vectors).max() < 1e-11 * size


def test_sturm_counts_count_smaller_eigenvalues():
    diag, off, _ = W.tridiagonal(next(matrices()))
    known = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(known[0] - 1, known[-1] + 1, 50)
    assert W.sturm_counts(diag, off, at).tolist() == [(known < t).sum() for t in at]


def brute(vectors):
    """The contract by integers and a dense solver."""
    rows = [v for v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64.0 * c)) + 1_000_000 for c in v] for v in rows]
    once = [list(t) for t in dict.fromkeys(map(tuple, x))]
    n, sums = len(once), [sum(col) for col in zip(*once)]
    gaps = np.array([[n * a - s for a, s in zip(v, sums)] for v in once], object)
    cov = np.array([[int(gaps[:, i] @ gaps[:, j]) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    values, u = np.linalg.eigh(cov)
    values, u = values[::-1][:16], u[:, ::-1][:, :16]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    return n, [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x], z @ u / np.sqrt(values), values / np.trace(cov)


def test_rows_equal_brute_force(spark):
    data = (RNG.standard_normal((300, 20)) @ RNG.standard_normal((20, 20)) / 8).astype(np.float32).astype(float).tolist()
    data += [data[0]] * 60 + [None, [None] + data[0][1:], [float("nan")] + data[0][1:], data[0][1:] + [float("inf")]]
    rows = [(i % 350, v, "k", 1) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, x int").repartition(5)
    out = W.whiten(df).collect()
    n, far, whitened, explained = brute(data)
    assert len(out) == 360 * 16
    found = {}
    for r in out:
        found.setdefault(r["vec_id"], []).append(r)
    sign = {}
    for i in range(100):
        mine = sorted(found[i], key=lambda r: r["component"])
        assert {r["n"] for r in mine} == {n} and {r["deviation"] for r in mine} >= {far[i]}
        for r in mine[:16] if len(mine) == 16 else []:
            c = r["component"] - 1
            sign.setdefault(c, np.sign(r["whitened"] * whitened[i][c]))
            assert abs(r["whitened"] * sign[c] - whitened[i][c]) < 1e-8
            assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [0.5, 0.5])] * 3, [(1, [])], [(None, [0.25, 1.0]), (2, [0.5, 2.0])],
    [(1, [0.25, 1.0]), (2, [0.5]), (3, [0.0, 3.0])], [(1, [1e300, -1e300]), (2, [0.0, 1.0])],
])
def test_edge_tables(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = W.whiten(df).collect()
    if len({str(v) for _, v in rows}) < 2:
        assert out == []
    else:
        assert {r["vec_id"] for r in out} == {i for i, _ in rows}
        assert all(r["identity_error"] < 1e-6 for r in out)


def test_deviation_passes_64_bits(spark):
    assert W.deviations(np.array([[2**60], [0]]), 2, [2**60]) == [None, None]
    assert W.deviations(np.array([[3], [1]]), 2, [4]) == [4, 4]
    big = np.array([[2**62, -1], [2**62, -5]])
    assert W.exact_sums(big) == [2**63, -6]
