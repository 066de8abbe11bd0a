"""Last-kept-point rule: block effects, folds across blocks and paths off the grid, against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import path as P, spacing

APART = 0.01


def plain(points, apart=APART):
    """Positions kept by a plain loop over (pos, x, y)."""
    kept, last = [], None
    for pos, x, y in points:
        if last is None or abs(x - last[0]) > apart or abs(y - last[1]) > apart:
            kept.append(pos)
            last = x, y
    return kept


def drift(seed: int, n: int, step: float):
    """A path whose steps are mostly smaller than the distance, so that each decision hangs on others."""
    r = random.Random(seed)
    x, y, out = 50.0, 40.0, []
    for pos in range(n):
        x += r.choice((0.0, step, step, -step, 0.3 * step)) + r.gauss(0, step / 20)
        y += r.choice((0.0, 0.0, step / 2, -step / 2))
        out.append((pos, x, y))
    return out


PATHS = {
    **{i: drift(i, 60, 0.004) for i in range(12)},
    **{20 + i: drift(i, 90, 0.0007) for i in range(8)},
    40: [(j, 50.0 + 0.0004 * j, 40.0) for j in range(120)],  # one slow line: no sure point anywhere
    41: [(j, 50.0, 40.0) for j in range(40)],
    42: [(0, 1.0, 1.0)],
    43: [(j, 50.0 + 0.006 * (j % 2), 40.0) for j in range(50)],  # to and fro within the distance
}


def table(spark, bits: int):
    rows = [(k, pos >> bits, pos, x, y) for k, pts in PATHS.items() for pos, x, y in pts]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "k long, block long, pos long, x double, y double").repartition(5)


def test_effect_of_a_block_is_that_of_the_loop():
    """For any point kept before, the summary gives the point that the loop ends with."""
    r = random.Random(3)
    for seed in range(60):
        pts = drift(seed, r.randint(1, 40), r.choice((0.0005, 0.003, 0.008)))
        x, y = np.array([p[1] for p in pts]), np.array([p[2] for p in pts])
        effect = spacing.block_effect(x, y, APART)
        entries = [(pts[0][1] + r.uniform(-0.02, 0.02), pts[0][2] + r.uniform(-0.02, 0.02)) for _ in range(60)]
        for at in [None, *entries, (pts[-1][1], pts[-1][2])]:
            last = at
            for _, px, py in pts:
                if last is None or abs(px - last[0]) > APART or abs(py - last[1]) > APART:
                    last = px, py
            assert spacing.after_block(at, effect, APART) == last


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_kept_points_equal_the_loop_across_blocks(spark, bits):
    got: dict[int, list[int]] = {}
    for row in spacing.kept_points(table(spark, bits), ["k"], APART).orderBy("k", "pos").collect():
        got.setdefault(row["k"], []).append(row["pos"])
    assert got == {k: plain(pts) for k, pts in PATHS.items()}
    # The rule of neighbours is another one here, so this fixture tells them apart.
    assert any(len(plain(pts)) != 1 + sum(
        abs(b[1] - a[1]) > APART or abs(b[2] - a[2]) > APART for a, b in zip(pts, pts[1:])
    ) for pts in PATHS.values())


def test_only_paths_off_the_grid_are_folded(spark):
    on_grid = spark.createDataFrame(
        [(99, 0, 0, 1.0, 2.0), (99, 0, 1, 1.0, 2.0), (99, 0, 2, 1.1, 2.0)], "k long, block long, pos long, x double, y double"
    )
    assert spacing.without_repeats(on_grid, ["k"], APART) is on_grid
    off = table(spark, 2).union(on_grid)
    got: dict[int, list[int]] = {}
    for row in spacing.without_repeats(off, ["k"], APART).orderBy("k", "pos").collect():
        got.setdefault(row["k"], []).append(row["pos"])
    # Repeats of a path on the grid stay: their steps have no length.
    still = {k for k, pts in PATHS.items() if k in (41, 42)}
    assert got == {99: [0, 1, 2]} | {k: [p[0] for p in pts] if k in still else plain(pts) for k, pts in PATHS.items()}


def test_resampled_length_is_that_of_the_kept_points(spark):
    """A drifting path is measured between kept points, not lost to steps below the distance."""
    steps = P.path_steps(spacing.without_repeats(table(spark, 3), ["k"], APART), ["k"])
    got = {r["k"]: r["total"] for r in steps.groupBy("k").agg(F.max("total").alias("total")).collect()}
    for k, pts in PATHS.items():
        at = {p[0]: p[1:] for p in pts}
        kept = [at[p] for p in plain(pts)]
        assert got[k] == pytest.approx(sum(float(np.hypot(b[0] - a[0], b[1] - a[1])) for a, b in zip(kept, kept[1:])))
    path = P.resample(table(spark, 3).filter("k = 40"), ["k"], 3).first()["path_xy"]
    kept = [PATHS[40][p] for p in plain(PATHS[40])]
    assert path[2] == pytest.approx((kept[0][1] + kept[-1][1]) / 2)
    assert path[-2] == pytest.approx(kept[-1][1])


def test_no_points(spark):
    empty = table(spark, 2).limit(0)
    assert spacing.kept_points(empty, ["k"], APART).count() == 0
    assert spacing.without_repeats(empty, ["k"], APART).count() == 0


def test_blocks_fold_side_by_side_like_one_by_one(monkeypatch):
    """Short and long blocks, with and without a point kept before, in any mixture."""
    r = random.Random(9)
    for few in (0, 3, 100):
        monkeypatch.setattr(spacing, "FEW", few)
        blocks = [drift(s, r.choice((1, 2, 7, 60)), r.choice((0.001, 0.004, 0.02))) for s in range(40)]
        fresh = np.array([r.random() < 0.5 for _ in blocks])
        before = np.array([[b[0][1] + r.uniform(-0.02, 0.02), b[0][2]] for b in blocks]).T
        x, y = (np.array([p[i] for b in blocks for p in b]) for i in (1, 2))
        cuts = np.cumsum([0, *map(len, blocks)])
        got = spacing.folded(x, y, cuts, before, fresh, APART)
        for i, b in enumerate(blocks):
            entered = [] if fresh[i] else [(-1, *before[:, i])]
            want = [p for p in plain(entered + b) if p >= 0]
            assert np.flatnonzero(got[cuts[i] : cuts[i + 1]]).tolist() == want


def test_blocks_go_through_batches_whole(spark):
    """Many blocks share a batch, and one may span several; before, each was a call of Python of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for bits in (1, 5):
            got: dict[int, list[int]] = {}
            found = spacing.kept_points(table(spark, bits), ["k"], APART)
            assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
            for row in found.orderBy("k", "pos").collect():
                got.setdefault(row["k"], []).append(row["pos"])
            assert got == {k: plain(pts) for k, pts in PATHS.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
