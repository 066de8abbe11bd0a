"""Freeze frames: orientation, borrowed frames, flips, masks."""

from __future__ import annotations

import pytest

from phasegrid.operators import frames as FR

DOT = "struct<teammate: boolean, actor: boolean, keeper: boolean, location: array<double>>"


def dot(x, y, teammate=True, actor=False, keeper=False):
    return (teammate, actor, keeper, None if x is None else [float(x), float(y)])


CASES = {
    # name: (event x/y, ours, dots, area, orientation, xs, ys, flags, area out)
    "on the event": ((30.0, 20.0), True, [dot(30.04, 19.96, actor=True), dot(10, 40, False, keeper=True)], None,
                     "event", [30.04, 10], [19.96, 40], [3, 4], []),
    "their event": ((30.0, 20.0), False, [dot(30, 20, actor=True), dot(100, 60, False)], [120.0, 80.0, 0.0, 80.0],
                    "event", [90, 20], [60, 20], [2, 1], [0, 0, 120, 0]),
    "re-oriented": ((30.0, 20.0), True, [dot(90.6, 60.6, actor=True), dot(80, 50, False)], [1.0, 2.0, 3.0],
                    "mirrored", [29.4, 40], [19.4, 30], [3, 0], [119, 78]),
    "borrowed": ((30.0, 20.0), True, [dot(120.1 - 30, 80.1 - 20, actor=True), dot(80, 50, False)], None,
                 "mirrored", [29.9, 40], [19.9, 30], [2, 1], []),
    "no actor": ((30.0, 20.0), True, [dot(30, 20)], None, "unknown", [30], [20], [1], []),
    "two actors": ((30.0, 20.0), True, [dot(30, 20, actor=True), dot(31, 21, actor=True)], None,
                   "unknown", [30, 31], [20, 21], [3, 3], []),
    "far actor": ((30.0, 20.0), True, [dot(5, 70, actor=True)], None, "unknown", [5], [70], [3], []),
    "no event place": ((None, None), True, [dot(30, 20, actor=True)], None, "unknown", [30], [20], [3], []),
    "off the pitch": ((-2.5, 79.5), True, [dot(-2.5, 80.5, actor=True)], None, "event", [-2.5], [80.5], [3], []),
    "missing dot place": ((30.0, 20.0), True, [dot(30, 20, actor=True), dot(None, None)], None, "event", [30], [20], [3], []),
}


@pytest.fixture(scope="module")
def framed(spark):
    frames, facts = [], []
    for i, (name, (at, ours, dots, area, *_)) in enumerate(CASES.items()):
        frames.append((1, name, area, dots))
        facts.append((1, name, "p", i, i, at[0], at[1], 1 if ours else 2, 1))
    frames.append((1, "empty", None, [dot(None, None, actor=True)]))
    facts.append((1, "empty", "p", 99, 99, 30.0, 20.0, 1, 1))
    f = spark.createDataFrame(
        frames, f"match_id int, event_uuid string, visible_area array<double>, freeze_frame array<{DOT}>")
    e = spark.createDataFrame(
        facts, "match_id int, event_uuid string, phase_id string, idx int, event_index int, x double, y double, team_id int, chain_team_id int")
    return FR.frame_scalars(f).join(e, ["match_id", "event_uuid"])


def test_canonical_frames(framed):
    got = {r["event_uuid"]: r for r in FR.canonicalize(framed).collect()}
    assert "empty" not in got and set(got) == set(CASES)
    for name, (_, _, _, _, orient, xs, ys, flags, area) in CASES.items():
        r = got[name]
        assert r["orientation"] == orient, name
        assert r["px"] == pytest.approx(xs, abs=1e-4) and r["py"] == pytest.approx(ys, abs=1e-4), name
        assert r["flags"] == flags and r["n_players"] == len(xs), name
        assert r["visible_area"] == pytest.approx(area), name


def test_keeper_tally(framed):
    rows = FR.keeper_sides(framed).collect()
    assert [(r["orientation"], r["teammate"], r["side"], r["n"], r["share"]) for r in rows] == [("event", False, "near_0", 1, 1.0)]
