"""Key-frames, positions on a grid, current frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from phasegrid.functions import scan
from phasegrid.operators import replay as R

COLS = "match_id int, phase_id string, idx int, event_uuid string, t_offset_s double, type_id int, team_side string, x double, y double, end_x double, end_y double"
OURS, THEIRS = "in_possession", "opponent"


def ev(phase, idx, t, type_id, at=(None, None), to=(None, None), side=OURS):
    return (1, phase, idx, f"{phase}-{idx}", float(t), type_id, side, *at, *to)


MOVE = [
    ev("a", 0, 0.0, 2, (30.5, 63.8)), ev("a", 1, 0.0, 43, (30.5, 63.8), (77.7, 61.4)), ev("a", 2, 6.5, 30, (77.7, 61.4), (107.5, 33.8)),
    ev("a", 3, 8.5, 42, (107.5, 33.8)), ev("a", 4, 8.5, 43, (107.5, 33.8), (112.4, 34.7)), ev("a", 5, 9.0, 17, (104.5, 33.8), side=THEIRS),
    ev("a", 6, 9.5, 30, (112.4, 34.7), (116.8, 41.8)), ev("a", 7, 10.0, 17, (50.0, 50.0)), ev("a", 8, 10.5, 16, (115.9, 43.0), (120.0, 42.1)),
    ev("b", 0, 1.0, 30, (10.0, 10.0), (20.0, 20.0)), ev("b", 1, 1.0, 42, (20.0, 20.0)),
    ev("c", 0, 0.0, 17, (1.0, 1.0), side=THEIRS), ev("d", 0, 0.25, 42, (5.0, 6.0)),
]


def plain_keys(events):
    kept = [e for e in events if e[6] == OURS and e[5] != 17 and e[7] is not None]
    keys = []

    def push(t, x, y):
        if keys and keys[-1][1:] == [x, y]:
            keys[-1][0] = min(keys[-1][0], t)
        else:
            keys.append([t, x, y])

    for i, e in enumerate(kept):
        push(e[4], e[7], e[8])
        if e[9] is not None:
            later = i + 1 < len(kept) and kept[i + 1][4] > e[4]
            push(kept[i + 1][4] if later else e[4] + 0.5, e[9], e[10])
    for i in range(1, len(keys)):
        keys[i][0] = max(keys[i][0], keys[i - 1][0])
    return keys


def plain_at(keys, t):
    if t <= keys[0][0]:
        return keys[0][1:]
    if t >= keys[-1][0]:
        return keys[-1][1:]
    i = next(k for k in range(1, len(keys)) if keys[k][0] >= t)
    a, b = keys[i - 1], keys[i]
    u = (t - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 1
    return [a[k] + (b[k] - a[k]) * u for k in (1, 2)]


@pytest.mark.parametrize("bits", [16, 1])
def test_keyframes_and_positions(spark, monkeypatch, bits):
    monkeypatch.setattr(scan, "BLOCK_BITS", bits)
    df = spark.createDataFrame(MOVE, COLS)
    keys = R.ball_keyframes(df).cache()
    got = {}
    for r in keys.orderBy("phase_id", "pos").collect():
        got.setdefault(r["phase_id"], []).append([r["t"], r["x"], r["y"]])
    want = {p: plain_keys([e for e in MOVE if e[1] == p]) for p in "abd"}
    assert got == want and "c" not in got
    phases = spark.createDataFrame([("a", 11.2), ("b", 1.0), ("c", 4.0), ("d", 0.1)], "phase_id string, duration_s double")
    seen = {}
    for r in R.ball_positions(keys, phases, 0.25).collect():
        assert (r["phase_id"], r["at"]) not in seen, "one position per grid time"
        seen[r["phase_id"], r["at"]] = [r["x"], r["y"]]
    ends = {"a": 11.2, "b": 1.0, "d": 0.5}
    assert len(seen) == sum(int(max(e, want[p][-1][0]) / 0.25) + 1 for p, e in ends.items())
    for (p, t), xy in seen.items():
        assert xy == pytest.approx(plain_at(want[p], t)), (p, t)
    for at in (-1.0, 0.0, 7.0, 8.5, 10.2, 99.0):
        trail = R.trail(keys, spark.createDataFrame([("a", at)], "phase_id string, at double")).collect()
        passed = [[r["t"], r["x"], r["y"]] for r in sorted(trail, key=lambda r: r["pos"] or 0) if not r["head"]]
        assert passed == [k for k in want["a"] if k[0] <= at]
        (head,) = [r for r in trail if r["head"]]
        assert [head["x"], head["y"]] == pytest.approx(plain_at(want["a"], at))
    assert {r["type_id"] for r in R.markers(df).select("type_id").distinct().collect()} == {2, 43, 30, 16}


def test_current_frames(spark):
    df = spark.createDataFrame(MOVE, COLS)
    frames = df.filter("phase_id = 'a' AND idx IN (2, 3, 4)").select("match_id", "phase_id", "idx", "event_uuid").unionByName(
        spark.createDataFrame([(1, "d", 7, "nowhere")], "match_id int, phase_id string, idx int, event_uuid string"))
    timed = R.timed_frames(df, frames)
    assert timed.filter("phase_id = 'd'").first()["t"] == 0.0
    phases = spark.createDataFrame([("a", 12.0), ("d", 0.1)], "phase_id string, duration_s double")
    got = {(r["phase_id"], r["at"]): (r["idx"], r["opacity"]) for r in R.current_frames(timed, phases, 0.5).collect()}
    assert ("a", 6.0) not in got and got["a", 6.5] == (2, 1.0) and got["a", 8.0] == (2, 1.0)
    assert got["a", 8.5] == (4, 1.0)  # of two frames at one time the later wins
    assert got["a", 10.5][1] == pytest.approx(1 - 0.5 / 3) and got["a", 12.0][1] == pytest.approx(0.32, abs=0.02)
    assert spark.range(1).select(R.opacity(F.lit(99.0))).first()[0] == 0.32
    assert got["d", 0.5] == (7, 1.0)
