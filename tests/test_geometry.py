"""Mirrors, zones, path resampling, strides."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import geometry as G
from phasegrid.functions.vectors import dot
from phasegrid.operators import path as P


def test_event_mirror_is_exact_on_the_whole_grid(spark):
    """Every 0.1 grid point: mirroring twice is the identity, and zones are closed."""
    xs = spark.range(1, 1201).select((F.col("id") / 10).alias("x"))
    ys = spark.range(1, 801).select((F.col("id") / 10).alias("y"))
    x, y = F.col("x"), F.col("y")
    bad = xs.filter((G.mirror_x(G.mirror_x(x)) != x) | (F.abs(x + G.mirror_x(x) - 120.1) > 1e-9))
    assert bad.count() == 0
    assert ys.filter(G.mirror_y(G.mirror_y(y)) != y).count() == 0
    found = {
        r[0]
        for a in xs.select(G.third(x)).distinct().collect()
        for r in [(a[0] + "_" + b[0],) for b in ys.select(G.channel(y)).distinct().collect()]
    }
    assert found == set(K.ZONES)


def test_scalars(spark):
    rows = [
        (0.1, 0.1, "def_third_left"), (39.9, 40.0, "def_third_centre"), (40.0, 40.0, "mid_third_centre"),
        (80.0, 26.66, "final_third_left"), (60.0, 26.67, "mid_third_centre"), (120.0, 53.34, "final_third_right"),
    ]
    df = spark.createDataFrame(rows, "x double, y double, z string")
    assert df.filter(G.zone(F.col("x"), F.col("y")) != F.col("z")).count() == 0
    one = spark.range(1).select(
        G.clock_seconds(F.lit("01:02:03.250")).alias("ts"),
        G.absolute_seconds(F.lit(3), F.lit(1.5)).alias("abs"),
        G.in_box(F.lit(102.0), F.lit(18.0)).alias("corner_in"),
        G.in_box(F.lit(101.9), F.lit(40.0)).alias("out_x"),
        G.in_box(F.lit(110.0), F.lit(62.1)).alias("out_y"),
        G.phase_id(F.lit(7), F.lit(12)).alias("id"),
        G.phase_id(F.lit(7), F.lit(123456)).alias("long_id"),
        G.match_of(F.lit("77-0001")).alias("match"),
        G.canonical_location(F.array(F.lit(10.0), F.lit(20.0), F.lit(2.5)), F.lit(True)).alias("flipped"),
        G.canonical_location(F.array(F.lit(10.0), F.lit(20.0)), F.lit(False)).alias("plain"),
        G.canonical_location(F.lit(None).cast("array<double>"), F.lit(True)).alias("none"),
        G.clamp_x(F.lit(-3.0)).alias("cx"), G.clamp_y(F.lit(90.0)).alias("cy"),
        G.clamp_x(F.lit(-9.0)).alias("far_x"), G.clamp_y(F.lit(None).cast("double")).alias("no_y"),
        G.lookup(F.lit(99), {1: "a"}).alias("unknown"), G.lookup(F.lit("k"), {"k": "it's"}).alias("quoted"),
        G.flag(F.lit(None)).alias("missing_flag"), G.zone_third(F.lit("mid_third_left")).alias("third"),
    ).first()
    assert (one["ts"], one["abs"]) == (3723.25, 5401.5)
    assert (one["corner_in"], one["out_x"], one["out_y"]) == (True, False, False)
    assert (one["id"], one["long_id"], one["match"]) == ("7-0012", "7-123456", 77)
    assert tuple(one["flipped"]) == (110.1, 60.1, 2.5)
    assert tuple(one["plain"]) == (10.0, 20.0, None) and tuple(one["none"]) == (None, None, None)
    assert (one["cx"], one["cy"], one["unknown"], one["quoted"]) == (-3.0, 84.0, None, "it's")
    assert (one["far_x"], one["no_y"]) == (-4.0, None)
    assert (one["missing_flag"], one["third"]) == (False, "mid_third")


def resample_plain(points, n):
    """Straight reading of the rule, for comparison."""
    kept = [points[0]]
    for p in points[1:]:
        if max(abs(p[0] - kept[-1][0]), abs(p[1] - kept[-1][1])) > 0.01:
            kept.append(p)
    cum = [0.0]
    for a, b in zip(kept, kept[1:]):
        cum.append(cum[-1] + math.dist(a, b))
    out = []
    for i in range(n):
        want = cum[-1] if n == 1 else cum[-1] * i / (n - 1)
        s = next((k for k in range(1, len(cum)) if cum[k] >= want), len(cum) - 1)
        if len(kept) == 1:
            out += kept[0]
            continue
        t = (want - cum[s - 1]) / (cum[s] - cum[s - 1])
        out += [kept[s - 1][k] + t * (kept[s][k] - kept[s - 1][k]) for k in (0, 1)]
    return out


grid = st.tuples(st.integers(0, 40).map(float), st.integers(0, 30).map(float))


def test_resample_matches_the_rule(spark, monkeypatch):
    """Random grid polylines, several sample counts, blocks of two points."""
    from phasegrid.functions import scan

    monkeypatch.setattr(scan, "BLOCK_BITS", 1)
    drawn: list[list[tuple[float, float]]] = []

    @settings(max_examples=40, deadline=None, database=None, derandomize=True)
    @given(st.lists(grid, min_size=1, max_size=12))
    def draw(points):
        drawn.append(points)

    draw()
    rows = [(i, j, j >> 1, *p) for i, pts in enumerate(drawn) for j, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "k int, pos long, block long, x double, y double").cache()
    for n in (1, 2, 3, 20):
        got = {r["k"]: r["path_xy"] for r in P.resample(df, ["k"], n).collect()}
        assert set(got) == set(range(len(drawn)))
        for k, pts in enumerate(drawn):
            assert got[k] == pytest.approx(resample_plain(pts, n), abs=1e-9), (n, pts)


def test_stride_and_thinning(spark):
    df = spark.range(0, 200).select(F.col("id").alias("idx"))
    kept = [r[0] for r in df.filter(P.stride_keep(F.col("idx"), F.lit(200), 64)).orderBy("idx").collect()]
    want = sorted({round(i * (199 / 63)) if i < 63 else 199 for i in range(64)})
    assert kept == want and kept[0] == 0 and kept[-1] == 199
    assert df.filter("idx < 5").filter(P.stride_keep(F.col("idx"), F.lit(5), 64)).count() == 5
    flat = F.array(*[F.lit(float(i)) for i in range(40)])
    thin = spark.range(1).select(P.thin_path(flat)).first()[0]
    assert thin == [float(2 * i + k) for i in K.TRAJECTORY_INDEX for k in (0, 1)]


def test_dot_uses_doubles(spark):
    v = F.array(F.lit(0.1), F.lit(0.2)).cast("array<float>")
    assert spark.range(1).select(dot(v, v)).first()[0] == pytest.approx(0.05, abs=1e-8)
