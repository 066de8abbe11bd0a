"""As-of join against plain loops, across slices."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import replay as R
from phasegrid.operators.asof import as_of


def joined(left, right, slices):
    return as_of(left, right, ["k"], F.col("at"), F.col("t"), F.col("n"), slices)


@pytest.mark.parametrize("slices", [1, 9])
def test_equals_plain_loops(spark, slices):
    rng = random.Random(3)
    right = [(rng.choice("abc"), rng.choice([None, *range(12)]), i, rng.random()) for i in range(300)]
    left = [(rng.choice("abcd"), rng.choice([None, *map(float, range(-1, 14))]), i) for i in range(200)]
    out = joined(
        spark.createDataFrame(left, "k string, at double, id long"),
        spark.createDataFrame([(k, None if t is None else float(t), n, v) for k, t, n, v in right], "k string, t double, n long, v double"),
        slices,
    ).collect()
    assert len(out) == len(left)
    want = {}
    for k, at, i in left:
        before = [(t, n, v) for q, t, n, v in right if q == k and t is not None and at is not None and t <= at]
        want[i] = max(before, default=(None, None, None))
    assert {r["id"]: (r["t"], r["n"], r["v"]) for r in out} == want
    assert out[0].asDict().keys() == {"k", "at", "id", "t", "n", "v"}


def test_one_chain_with_all_frames_at_one_time(spark):
    n = 100_000
    frames = spark.range(n).select(F.lit("p").alias("phase_id"), F.col("id").alias("idx"), F.lit(0.0).alias("t"))
    phases = spark.createDataFrame([("p", 2.0), ("q", 1.0)], "phase_id string, duration_s double")
    got = R.current_frames(frames, phases, 0.5, slices=8)
    assert sorted((r["at"], r["idx"]) for r in got.collect()) == [(i / 2, n - 1) for i in range(5)]


def test_slices_are_bounded_however_keys_and_times_crowd(spark, monkeypatch):
    from phasegrid.operators import asof

    kept = []
    save = asof.storage.save
    monkeypatch.setattr(asof.storage, "save", lambda df, path: kept.append(save(df, path)) or kept[-1])
    right = spark.range(20_000).select(F.lit("one").alias("k"), F.lit(1.0).alias("t"), F.col("id").alias("n"))
    left = spark.range(50).select(F.lit("one").alias("k"), (F.col("id") * 1.0).alias("at"))
    rows = joined(left, right, 10).collect()
    assert {r["n"] for r in rows if r["at"] >= 1} == {19_999} and [r["n"] for r in rows if r["at"] < 1] == [None]
    sizes = [r["count"] for r in kept[0].groupBy("_slice").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * 20_050 / 10


@pytest.mark.parametrize("empty", ["left", "right", "both"])
def test_empty_sides(spark, empty):
    left = spark.createDataFrame([("a", 1.0)], "k string, at double")
    right = spark.createDataFrame([("a", 0.5, 1)], "k string, t double, n long")
    left = left.limit(0) if empty != "right" else left
    right = right.limit(0) if empty != "left" else right
    assert [r["n"] for r in joined(left, right, 3).collect()] == ([None] if empty == "right" else [])
