"""JSON scans, file audit, table access, the built tables and their checks."""

from __future__ import annotations

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from phasegrid import catalog, constants as K
from phasegrid.plans import build as B, quality as Q, reports as RP
from phasegrid.sources import raw_json as J, storage, tables as TB


def raw(index, type_id, sub=None, **more):
    e = {
        "id": f"e{index}", "index": index, "period": 1, "timestamp": "00:00:01.500", "minute": 0, "second": 1,
        "type": {"id": type_id, "name": "x"}, "possession": 2, "possession_team": {"id": 1, "name": "A"},
        "team": {"id": 1, "name": "A"}, "play_pattern": {"id": 1, "name": "p"}, "location": [10.0, 20.0],
    }
    if sub:
        e[K.SUB_OBJECTS[type_id]] = sub
    return {**e, **more}


EVENTS = [
    raw(2, 30, {"end_location": [30.5, 40.0], "outcome": {"id": 9, "name": "Incomplete"}, "type": {"id": 61, "name": "Corner"},
                "switch": True, "cross": True, "height": {"id": 3, "name": "High Pass"}, "body_part": {"id": 37, "name": "Head"}}, under_pressure=True),
    raw(1, 18, location=None),
    raw(3, 16, {K.XG_FIELD: 0.25, "end_location": [120.0, 40.0, 1.5], "outcome": {"id": 97, "name": "Goal"}}, player={"id": 7, "name": "P"}),
    raw(4, 33, {"outcome": {"id": 4, "name": "Won"}}, counterpress=True, out=True),
    raw(5, 2, {"recovery_failure": True}), raw(6, 6, {"save_block": True}),
    raw(7, 23, {"type": {"id": 25, "name": "Collected"}, "end_location": [5.0, 40.0]}),
    raw(8, 4, {"type": {"id": 11, "name": "Tackle"}, "outcome": {"id": 16, "name": "Won"}}, carry={"end_location": [1.0, 1.0]}),
]


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    root = tmp_path_factory.mktemp("feed")
    for d in ("events", "frames", "matches/55"):
        (root / d).mkdir(parents=True)
    (root / "events" / "101.json").write_text(json.dumps(EVENTS, indent=1))
    frame = {"event_uuid": "e2", "visible_area": [0.0, 0.0, 5.0, 5.0],
             "freeze_frame": [{"teammate": True, "actor": True, "keeper": False, "location": [10.0, 20.0]}]}
    (root / "frames" / "101.json").write_text(json.dumps([frame, frame]))
    (root / "frames" / "102.json").write_text(json.dumps([frame]) + " " * 60_000)
    match = lambda i, stage: {
        "match_id": i, "match_date": f"2024-07-{i - 90:02d}", "competition_stage": stage,
        "home_team": {"home_team_id": 1, "home_team_name": "A"}, "away_team": {"away_team_id": 2, "away_team_name": "B"},
        "home_score": 2, "away_score": 1, "stadium": {"name": "S"}}
    (root / "matches/55/282.json").write_text(
        json.dumps([match(102, {"id": 26, "name": "The Final"}), match(101, {"id": 99, "name": "Play-off"}), match(103, {"id": 10, "name": "g"})]))
    return root


def test_events(spark, feed):
    rows = {r["index"]: r for r in J.flatten_events(J.read_events(spark, str(feed / "events" / "*.json"))).collect()}
    assert {r["match_id"] for r in rows.values()} == {101} and len(rows) == 8
    p = rows[2]
    assert (p["ts_s"], p["x"], p["end_x"], p["outcome_id"], p["sub_type_id"]) == (1.5, 10.0, 30.5, 9, 61)
    assert p["pass_switch"] and p["cross"] and p["high_pass"] and p["head_pass"] and not p["aerial_won"] and p["under_pressure"]
    assert rows[1]["x"] is None and not rows[1]["counterpress"]
    assert (rows[3]["xg"], rows[3]["end_z"], rows[3]["outcome_name"], rows[3]["player_name"]) == (0.25, 1.5, "Goal", "P")
    assert (rows[4]["outcome_id"], rows[4]["counterpress"], rows[4]["is_out"]) == (4, True, True)
    assert rows[5]["recovery_failure"] and rows[6]["save_block"]
    assert (rows[7]["sub_type_id"], rows[7]["end_x"]) == (25, 5.0)
    assert (rows[8]["sub_type_id"], rows[8]["outcome_id"], rows[8]["end_x"]) == (11, 16, None)  # only its own sub-object counts


def test_json_lines_layout(spark, feed, tmp_path):
    (tmp_path / "101.json").write_text("\n".join(json.dumps(e) for e in EVENTS))
    a = J.flatten_events(J.read_events(spark, str(tmp_path), lines=True))
    assert a.exceptAll(J.flatten_events(J.read_events(spark, str(feed / "events")))).count() == 0


def test_frames_matches_and_audit(spark, feed):
    frames = J.read_frames(spark, str(feed / "frames"))
    assert sorted((r["match_id"], r["event_uuid"]) for r in frames.collect()) == [(101, "e2"), (102, "e2")]
    matches = J.read_matches(spark, str(feed / "matches"), {(55, 282): "Euro 2024"})
    got = {r["match_id"]: r for r in matches.collect()}
    assert got[102]["label"] == "A 2–1 B · Euro 2024 Final" and got[101]["stage"] == "Play-off"
    assert (got[101]["competition_id"], got[101]["season_id"], got[101]["competition"], got[101]["stadium"]) == (55, 282, "Euro 2024", "S")
    assert [r["match_id"] for r in TB.first_matches(matches, 2).collect()] == [101, 102]
    audit = J.audit_files(spark, matches, {"events": str(feed / "events"), "frames": str(feed / "frames")})
    assert sorted((r["match_id"], r["kind"], r["problem"]) for r in audit.collect()) == [
        (101, "frames", "stub"), (102, "events", "missing"), (103, "events", "missing"), (103, "frames", "missing")]


@pytest.fixture(scope="module")
def built(spark):
    return B.testdata_tables(spark, "/root/testdata/sf0.001")


def test_declared_schemas(built):
    def kinds(df):
        return {f.name: f.dataType.simpleString() for f in df.schema.fields}

    phases = kinds(built.phases)
    phases.pop("start_index")
    assert phases == B.PHASE_COLUMNS and len(phases) == 43
    events, frames = kinds(built.phase_events), kinds(built.phase_frames)
    assert events.pop("match_id") and frames.pop("match_id")
    assert events.pop("bucket") and frames.pop("bucket")
    assert events == B.EVENT_COLUMNS and len(events) == 22
    assert frames == B.FRAME_COLUMNS and len(frames) == 9
    TB.register_views(built)
    n = built.phases.sparkSession.sql("SELECT count(*) FROM phases JOIN similarity USING (phase_id)").first()[0]
    assert n == built.phases.count()


def test_one_phase_reads_one_partition(built):
    q = TB.phase_rows(built.phase_events, 1003, "1003-0002")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert "EqualTo(match_id,1003)" in plan and "EqualTo(phase_id,1003-0002)" in plan
    rows = q.collect()
    assert [r["idx"] for r in rows] == list(range(len(rows))) and rows
    assert TB.match_rows(built.phase_events, [1001], ["phase_id", "idx"]).columns == ["match_id", "phase_id", "idx"]


def test_splits(built):
    a = {r["match_id"]: r["split"] for r in TB.assign_splits(built.matches, 5).collect()}
    assert a == {r["match_id"]: r["split"] for r in TB.assign_splits(built.matches.repartition(7), 5).collect()}
    assert set(a.values()) <= {"train", "validation", "test"}


def test_checks_run_before_their_rows_are_joined(built):
    """The driver never plans all checks as one; every check is still there once."""
    checks = Q.run_checks(built)
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    names = [r["check_id"] for r in checks.collect()]
    assert len(names) == len(set(names)) == 45


def test_retrieval_metrics_rank_each_mode_once(built):
    """No all-pairs work is left in the returned plan."""
    metrics = catalog.retrieval_metrics(built)
    assert "MapInPandas" not in metrics._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["mode"] for r in metrics.collect()) == ["generous", "strict"]


def test_ship_decision_probes_once(built, monkeypatch):
    """Ranks and probe are behind the returned plan; both rows share one probe."""
    probes, probe = [], catalog._probe
    monkeypatch.setattr(catalog, "_probe", lambda t: probes.append(t) or probe(t))
    decision = catalog.ship_decision(built)
    plan = decision._jdf.queryExecution().optimizedPlan().toString()
    assert len(probes) == 1 and "MapInPandas" not in plan and "Window" not in plan
    assert decision.count() == 1


def test_definitional_checks_pass(built):
    known_facts = {"odd_actor_count", "press_reaches"}  # facts of real matches, not of the view
    bad = [r["check_id"] for r in Q.run_checks(built).filter("NOT passed").collect()]
    assert set(bad) <= known_facts
    assert Q.manifest_checks(built, RP.manifest(built)).filter("bad_rows > 0").count() == 0
    near = Q.self_nearest(built.similarity).first()
    assert near["probe"] == near["nearest"] and near["score"] == pytest.approx(1.0, abs=1e-5)
    size = RP.table_bytes(built.phases.sparkSession, storage.work_dir(built.phases.sparkSession)).first()
    assert size["files"] > 0 and size["bytes"] > 0


def test_every_check_can_fail(built):
    """Corrupt a copy of the tables; each check must notice."""
    c, lit = F.col, F.lit
    first = built.phases.agg(F.min("phase_id")).first()[0]
    hit = c("phase_id") == first

    def spoil(df, **changes):
        return df.withColumns({k: F.when(hit, v).otherwise(c(k)).cast(df.schema[k].dataType) for k, v in changes.items()})

    def failed(df):
        return {r["check_id"] for r in df.collect() if r["bad_rows"] > 0}

    p = built.phases
    seen = set()
    for changes in (
        dict(seq=lit(999), xg=lit(1.5), period=lit(5), start_zone=lit("x"), start_type=lit("x"), outcome=lit("x"), n_events=lit(0),
             frame_coverage=lit(1.5), path_xy=F.slice(c("path_xy"), 1, 38), progression_m=lit(500.0), duration_s=lit(-1.0), high_press_regain=lit(True)),
        dict(competition=lit(None), start_x=lit(float("nan")), has_360=~c("has_360"), n_shots=lit(3), xg=lit(0.0), max_x=lit(-5.0), reached_box=lit(True), reached_final_third=lit(False)),
        dict(outcome=lit("shot_on_target"), n_shots=lit(0), path_xy=F.transform("path_xy", lambda v: v - 500), direct_speed_m_s=lit(900.0),
             duration_s=lit(2.0), reached_final_third=c("max_x") < 80),
        dict(high_press_regain=lit(True), start_type=lit("corner"), max_x=lit(70.0)),
    ):
        seen |= failed(Q.phase_checks(spoil(p, **changes)))
    seen |= failed(Q.event_checks(spoil(built.phase_events, team_side=lit("x"), x=lit(130.0))))
    seen |= failed(Q.frame_checks(built.phase_frames.withColumns({"orientation": lit("x"), "px": F.slice("px", 1, 1)})))
    seen |= failed(Q.vector_checks(spoil(built.similarity, vec=F.array(lit(float("nan"))))))
    seen |= failed(Q.link_checks(dataclasses.replace(
        built,
        phases=p.unionByName(p.filter(hit)).withColumn("opponent_id", F.when(hit, c("team_id")).otherwise(c("opponent_id")))
        .withColumn("match_id", F.when(hit, lit(1).cast("long")).otherwise(c("match_id")))
        .withColumn("outcome", lit("goal")).filter("match_id <> 1003"),
        matches=built.matches.unionByName(built.matches.limit(1).withColumn("match_id", lit(5).cast("long")))
        .unionByName(built.matches.limit(1).withColumns({"match_id": lit(1).cast("long"), "home_team_id": lit(8).cast("long")})),
        phase_events=built.phase_events.filter("idx <> 1").withColumn("has_frame", lit(False)),
    )))
    twice = built.similarity.filter(~hit)
    seen |= failed(Q.link_checks(dataclasses.replace(
        built, matches=built.matches.filter("match_id <> 1002"), similarity=twice.unionByName(twice))))
    every = {r["check_id"] for r in Q.run_checks(built).select("check_id").collect()}
    assert every - seen == set()
