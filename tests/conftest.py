"""Session and hand-built flat events."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from phasegrid.session import local_session  # noqa: E402

# Flat event columns and their types.
FLAT = {
    "match_id": "bigint", "index": "bigint", "event_uuid": "string", "period": "int",
    "possession": "int", "possession_team_id": "bigint", "team_id": "bigint",
    "team_name": "string", "ts_s": "double", "minute": "int", "second": "int",
    "duration": "double", "type_id": "int", "type_name": "string", "play_pattern_id": "int",
    "player_id": "bigint", "player_name": "string", "position_name": "string", "x": "double",
    "y": "double", "end_x": "double", "end_y": "double", "end_z": "double", "outcome_id": "int",
    "outcome_name": "string", "sub_type_id": "int", "xg": "double", "under_pressure": "boolean",
    "counterpress": "boolean", "is_out": "boolean", "pass_switch": "boolean",
    "recovery_failure": "boolean", "save_block": "boolean", "cross": "boolean",
    "through_ball": "boolean", "high_pass": "boolean", "head_pass": "boolean",
    "aerial_won": "boolean", "has_frame": "boolean", "related_events": "array<string>",
}


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "phasegrid-tests")


def event(index, type_id, at=None, to=None, *, match=1, period=1, poss=2, us=1, team=None, ts=10.0, **more):
    """One flat event: ``us`` owns the possession, ``team`` acts (default ``us``)."""
    team = us if team is None else team
    row = {name: False if kind == "boolean" else None for name, kind in FLAT.items()}
    row.update(
        match_id=match, index=index, event_uuid=f"u{match}-{index}", period=period,
        possession=poss, possession_team_id=us, team_id=team, team_name=f"T{team}", ts_s=float(ts),
        minute=0, second=int(ts) % 60, duration=0.5, type_id=type_id, type_name=f"Type{type_id}",
        play_pattern_id=1, player_id=100 + index % 3, player_name=f"P{100 + index % 3}",
    )
    if at:
        row["x"], row["y"] = map(float, at)
    if to:
        row["end_x"], row["end_y"] = float(to[0]), float(to[1])
    row.update(more)
    return row


def frame_of(spark, rows):
    ddl = ", ".join(f"{name} {kind}" for name, kind in FLAT.items())
    return spark.createDataFrame([tuple(r[name] for name in FLAT) for r in rows], ddl)


@pytest.fixture(scope="session")
def features(spark):
    """rows -> {match_id: [feature row, ...]} in chain order, with resampled paths."""
    from pyspark.sql import functions as F

    from phasegrid.operators import features as X, path as P
    from phasegrid.operators.segment import CHAIN, segment

    def run(rows):
        seg = segment(frame_of(spark, rows)).cache()
        out = X.build_features(X.aggregate_chains(seg), seg)
        ours = F.col("team_id") == F.col("chain_team_id")
        out = out.join(P.resample(P.path_points(seg, CHAIN, ours), CHAIN), CHAIN, "left")
        found = {}
        for r in out.orderBy("match_id", "seq").collect():
            found.setdefault(r["match_id"], []).append(r)
        return found

    return run
