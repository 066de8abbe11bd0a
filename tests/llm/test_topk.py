import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import topk as T

RNG = np.random.default_rng(13)


def brute(rows, k, step=50):
    """Every usable query against every usable row, by Python integers."""
    good = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, qv in good:
        if q is None or q % step:
            continue
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for i, v in good if i != q)
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, k=5, step=50, **how):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, rank string, ids int")
    df = df.repartition(3)
    out = T.top_k(df.where(F.col("vec_id") % step == 0), df, k, **how)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("k,block_rows,query_rows", [(5, 64, 3), (1, 2048, 256), (9, 7, 2)])
def test_results_equal_brute_force(spark, k, block_rows, query_rows):
    centres = RNG.standard_normal((4, 16))
    rows = [(i, ((centres[i % 4] + 0.3 * RNG.standard_normal(16)) / 5).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # ties
    assert searched(spark, rows, k, block_rows=block_rows, query_rows=query_rows) == brute(rows, k)


@pytest.mark.parametrize("rows", [
    [], [(0, [0.5, 1.0])], [(0, None), (1, [1.0])], [(0, [0.0, 0.0]), (7, [1.0, 2.0]), (3, [-1.0, 4.0]), (None, [2.0, 2.0])],
    [(0, [1.0, -2.0, 3.0]), (50, [1.0]), (51, []), (52, [None, 1.0]), (53, [float("nan")] * 3), (54, [0.5, 0.5, float("inf")])],
    [(i, [1.0, 1.0]) for i in range(120)] + [(0, [1.0, 1.0])] * 0,
    [(0, [2.0**22, -(2.0**22)]), (1, [2.0**20, 1.0]), (2, [2.0**20, 1.00390625])],
])
def test_edge_tables(spark, rows):
    assert searched(spark, rows, block_rows=40) == brute(rows, 5)


def test_repeated_query_rows_have_their_own_results(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 4.0])]
    assert searched(spark, rows) == [(0, 1, 1, 256 * 768), (0, 1, 1, 256 * 1024)]
    assert searched(spark, [(0, [2.0**54]), (1, [2.0**40])])[0][3] == 2**63 - 1


def test_reading_stops_before_the_end():
    """One row far ahead in every list: outsiders cannot qualify after the first reading."""
    x = RNG.integers(-20, 20, (1000, 8))
    x[137] = 500
    q = np.stack([np.full(8, 3), np.full(8, -3)])
    alive = np.ones((2, 1000), bool)
    rows, scores, share = T.best(T.Lists.of(x), q, 1, alive, np.full(2, -np.inf))
    assert rows[0].tolist() == [137] and scores[0].tolist() == [12_000] and share[0] < 1
    assert scores[1].max() == (x @ q[1]).max()
    bars = np.sort(x @ q.T, axis=0)[-3].astype(float)  # bars from other blocks shut out the rest
    rows, scores, share = T.best(T.Lists.of(x), q, 5, alive, bars)
    for i in range(2):
        assert sorted(rows[i].tolist()) == np.flatnonzero(x @ q[i] >= bars[i]).tolist()
    alive[0, 137] = False
    rows, scores, _ = T.best(T.Lists.of(x), q, 1, alive, np.full(2, -np.inf))
    assert 137 not in rows[0]


def test_lists_are_sorted_and_whole():
    x = RNG.integers(-9, 9, (50, 6))
    lists = T.Lists.of(x)
    assert (np.diff(lists.values, axis=1) <= 0).all() and (lists.vectors().T == x).all()
