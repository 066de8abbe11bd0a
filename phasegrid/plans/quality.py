"""Checks over the built tables: (check_id, bad_rows, total_rows, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import geometry as G
from phasegrid.functions import vectors as V
from phasegrid.functions.scan import by_shuffle
from phasegrid.plans import reports
from phasegrid.sources import storage

REQUIRED = (
    "phase_id", "match_id", "team_id", "opponent_id", "period", "possession", "duration_s",
    "n_events", "n_passes", "start_zone", "end_zone", "start_type", "outcome", "progression_m",
    "direct_speed_m_s", "xg", "frame_coverage", "path_xy", "match_label", "competition",
)
# Referential checks that run in one plan.
CHECKS_AT_ONCE = 3
FLOATS = (
    "start_ts", "end_ts", "abs_start_s", "duration_s", "start_x", "start_y", "end_x", "end_y",
    "max_x", "progression_m", "direct_speed_m_s", "xg", "frame_coverage",
)


def _any(terms) -> Column:
    return reduce(lambda a, b: a | b, terms)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All row-wise checks of a table in one aggregate; a NULL test counts as good."""
    aggs = [F.count_if(F.coalesce(bad, F.lit(False))).alias(k) for k, bad in checks.items()]
    wide = df.agg(F.count("*").alias("total_rows"), *aggs)
    return wide.unpivot("total_rows", list(checks), "check_id", "bad_rows").select(
        "check_id", "bad_rows", "total_rows"
    )


def _named(check_id: str, df: DataFrame, bad: Column, total: Column | None = None) -> DataFrame:
    """One check from one aggregate over ``df``."""
    counted = F.count("*") if total is None else total
    return df.agg(
        F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_rows"), counted.alias("total_rows")
    ).select(F.lit(check_id).alias("check_id"), "bad_rows", "total_rows")


def _orphans(check_id: str, left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Rows of ``left`` without a partner: one left join gives both the bad and the total count."""
    known = right.select(*key).distinct().withColumn("_hit", F.lit(True))
    # Matches are few; everything below them grows with the events.
    known = known if key == ("match_id",) else by_shuffle(known)
    joined = left.select(*key).join(known, list(key), "left")
    return _named(check_id, joined, F.col("_hit").isNull())


def _unique(check_id: str, df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return _named(check_id, sizes, F.col("n") > 1, F.coalesce(F.sum("n"), F.lit(0)))


def phase_checks(phases: DataFrame) -> DataFrame:
    x0, y0, x1, y1 = (_d(c) for c in ("start_x", "start_y", "end_x", "end_y"))
    path = F.col("path_xy")
    n = 2 * K.PATH_POINTS
    ends = F.greatest(
        F.abs(F.try_element_at(path, F.lit(1)).cast("double") - x0),
        F.abs(F.try_element_at(path, F.lit(2)).cast("double") - y0),
        F.abs(F.try_element_at(path, F.lit(n - 1)).cast("double") - x1),
        F.abs(F.try_element_at(path, F.lit(n)).cast("double") - y1),
    )
    off_path = F.exists(F.zip_with(path, F.sequence(F.lit(0), F.size(path) - 1), lambda v, i: (
        (v < 0) | F.when(i % 2 == 0, v > 120.1 + 1e-4).otherwise(v > 80.1 + 1e-4)
    )), lambda bad: bad)
    speed = _d("direct_speed_m_s") - _d("progression_m") / F.when(_d("duration_s") > 0.05, _d("duration_s"))
    return _row_checks(
        phases,
        {
            "phase_id_encodes": F.col("phase_id") != G.phase_id(F.col("match_id"), F.col("seq")),
            "required_present": _any([F.col(c).isNull() for c in REQUIRED]),
            "no_nan": _any([F.isnan(F.col(c)) for c in FLOATS]),
            "clock_forward": (_d("duration_s") < 0) | (_d("end_ts") < _d("start_ts")),
            "counts_consistent": (F.col("n_events") < 1)
            | (F.col("n_passes") < 0)
            | (F.col("n_players") < 0)
            | (F.col("n_passes") > F.col("n_events"))
            | (F.col("pressure_events") > F.col("n_events")),
            "coverage_range": (_d("frame_coverage") < 0) | (_d("frame_coverage") > 1),
            "coverage_flag": F.col("has_360") != (_d("frame_coverage") > 0),
            "xg_range": (_d("xg") < 0) | (_d("xg") > 1),
            "xg_needs_shot": (F.col("n_shots") == 0) != (_d("xg") == 0),
            "period_range": ~F.col("period").between(1, 4),
            "zone_values": ~F.col("start_zone").isin(*K.ZONES) | ~F.col("end_zone").isin(*K.ZONES),
            "start_type_values": ~F.col("start_type").isin(*K.START_TYPES),
            "outcome_values": ~F.col("outcome").isin(*K.OUTCOMES),
            "zone_recomputed": F.col("start_zone") != G.zone(x0, y0),
            "path_length": F.size(path) != n,
            "path_ends": ~(ends < 1e-3),
            "path_on_pitch": off_path,
            "progression": F.abs(_d("progression_m") - (x1 - x0) * K.YARD_M) >= 1e-3,
            "speed": F.abs(speed) >= 1e-3,
            "max_x": (_d("max_x") < x0 - 1e-3) | (_d("max_x") < x1 - 1e-3),
            "final_third_flag": F.col("reached_final_third") != (_d("max_x") >= 80),
            "box_in_final_third": F.col("reached_box") & ~F.col("reached_final_third"),
            "shot_outcome": F.col("outcome").isin("shot_on_target", "shot_off_target")
            & (F.col("n_shots") == 0),
            "press_open_play": F.col("high_press_regain")
            & (F.col("start_type") != "turnover_open_play"),
            "press_reaches": F.col("high_press_regain") & (_d("max_x") < 80),
        },
    )


def event_checks(phase_events: DataFrame) -> DataFrame:
    x, y = _d("x"), _d("y")
    return _row_checks(
        phase_events,
        {
            "side_values": ~F.col("team_side").isin(*K.TEAM_SIDES),
            "event_on_pitch": (x < 0) | (x > 120.1 + 1e-4) | (y < 0) | (y > 80.1 + 1e-4),
        },
    )


def actor_count(flags: Column) -> Column:
    return F.aggregate(
        flags, F.lit(0), lambda acc, f: acc + F.shiftright(f.cast("int"), 1).bitwiseAND(1)
    )


def frame_checks(phase_frames: DataFrame) -> DataFrame:
    actors = actor_count(F.col("flags"))
    return _row_checks(
        phase_frames,
        {
            "orientation_values": ~F.col("orientation").isin(*K.ORIENTATIONS),
            "dots_parallel": (F.size("px") != F.size("py"))
            | (F.size("px") != F.size("flags"))
            | (F.size("px") != F.col("n_players"))
            | (F.col("n_players") < 1),
            "resolved_one_actor": (actors != 1) & (F.col("orientation") != "unknown"),
            "odd_actor_count": actors != 1,
        },
    )


def vector_checks(similarity: DataFrame) -> DataFrame:
    norm = F.sqrt(V.dot(F.col("vec"), F.col("vec")))
    return _row_checks(
        similarity,
        {
            "vector_length": F.size("vec") != K.VECTOR_DIM,
            "vector_unit": ~(F.abs(norm - 1.0) < 1e-5),
            "vector_nan": F.exists("vec", lambda v: F.isnan(v)),
        },
    )


def _link_parts(t) -> list[DataFrame]:
    """Referential checks one by one: anti-joins and uniqueness."""
    phases, matches, events = t.phases, t.matches, t.phase_events
    teams = phases.select("match_id", "team_id", "opponent_id").join(
        matches.select("match_id", "home_team_id", "away_team_id"), "match_id"
    )
    pair = [F.col("home_team_id"), F.col("away_team_id")]
    wrong_team = (
        ~F.col("team_id").isin(*pair)
        | ~F.col("opponent_id").isin(*pair)
        | (F.col("team_id") == F.col("opponent_id"))
    )
    drawn = t.phase_frames.select("phase_id", "idx", F.lit(True).alias("_drawn"))
    claimed = events.select("phase_id", "idx", "has_frame").join(by_shuffle(drawn), ["phase_id", "idx"], "left")
    cover = events.groupBy("phase_id").agg(F.avg(F.col("has_frame").cast("double")).alias("seen"))
    stored = phases.select("phase_id", "frame_coverage").join(by_shuffle(cover), "phase_id", "left")
    ours = F.col("team_side") == "in_possession"
    goals = events.filter(
        (ours & (F.col("type_id") == K.SHOT) & (F.col("outcome_name") == "Goal"))
        | (~ours & (F.col("type_id") == K.OWN_GOAL_AGAINST))
    )
    scored = phases.filter(F.col("outcome") == "goal")
    return [
        _unique("phase_id_unique", phases, "phase_id"),
        _unique("vector_unique", t.similarity, "phase_id"),
        _orphans("phase_has_match", phases, matches, "match_id"),
        _orphans("match_has_phases", matches, phases, "match_id"),
        _orphans("event_has_phase", events, phases, "phase_id"),
        _orphans("frame_has_event", t.phase_frames, events, "phase_id", "idx", "event_uuid"),
        _orphans("phase_has_vector", phases, t.similarity, "phase_id"),
        _orphans("goal_has_event", scored, goals, "phase_id"),
        _named("team_in_match", teams, wrong_team),
        _named("frame_where_claimed", claimed, ~F.col("has_frame") & F.col("_drawn")),
        _named(
            "coverage_recomputed",
            stored,
            F.abs(F.col("seen") - _d("frame_coverage")) >= 1e-6,
        ),
    ]


def link_checks(t) -> DataFrame:
    """All referential checks."""
    return reduce(DataFrame.unionByName, _link_parts(t))


def goal_balance(t) -> DataFrame:
    """Goals per competition: chain flags (scored + conceded) against goal events."""
    flags = t.phases.groupBy("competition").agg(
        F.count_if(F.col("outcome") == "goal").alias("scored"),
        F.count_if("goal_conceded").alias("conceded"),
    )
    marks = t.phase_events.select("phase_id", "type_id", "outcome_name").filter(
        ((F.col("type_id") == K.SHOT) & (F.col("outcome_name") == "Goal"))
        | (F.col("type_id") == K.OWN_GOAL_AGAINST)
    )
    events = (
        marks.join(by_shuffle(t.phases.select("phase_id", "competition")), "phase_id")
        .groupBy("competition")
        .agg(
            F.count_if(F.col("type_id") == K.SHOT).alias("goal_shots"),
            F.count_if(F.col("type_id") == K.OWN_GOAL_AGAINST).alias("own_goals"),
        )
    )
    return flags.join(events, "competition")


def score_balance(phases: DataFrame, matches: DataFrame) -> DataFrame:
    """Chain goals against final scores, overall."""
    from_phases = phases.agg(
        (F.count_if(F.col("outcome") == "goal") + F.count_if("goal_conceded")).alias("from_phases")
    )
    from_scores = matches.agg(F.sum(F.col("home_score") + F.col("away_score")).alias("from_scores"))
    return from_phases.join(F.broadcast(from_scores), F.lit(True))


def plausibility(phases: DataFrame) -> DataFrame:
    """Where restarts start: share of odd places per start type."""
    x, y = _d("start_x"), _d("start_y")
    odd = (
        F.when(F.col("start_type") == "kick_off", (F.abs(x - 60) > 6) | (F.abs(y - 40) > 12))
        .when(F.col("start_type") == "corner", (x < 110) | ((y > 12) & (y < 68)))
        .when(F.col("start_type") == "goal_kick", x >= 20)
    )
    return (
        phases.filter(F.col("start_type").isin("kick_off", "corner", "goal_kick"))
        .groupBy("start_type")
        .agg(
            F.count("*").alias("n"),
            F.count_if(odd).alias("odd"),
            (F.count_if(odd) / F.count("*")).alias("odd_share"),
        )
    )


def self_nearest(similarity: DataFrame) -> DataFrame:
    """The first phase is its own nearest neighbour, with score 1."""
    probe = similarity.agg(
        F.min_by("vec", "phase_id").alias("target"), F.min("phase_id").alias("probe")
    )
    scored = similarity.join(F.broadcast(probe), F.lit(True)).select(
        "probe", "phase_id", V.dot(F.col("vec"), F.col("target")).alias("score")
    )
    return scored.groupBy("probe").agg(
        F.max_by("phase_id", "score").alias("nearest"), F.max("score").alias("score")
    )


def manifest_checks(t, stored: DataFrame) -> DataFrame:
    """The stored manifest against the tables and files as they are now, and every match has its
    event and frame rows."""
    now = reports.manifest(t).select("item", F.col("value").alias("rows"))
    equal = now.join(stored, "item", "full").select(
        F.concat(F.lit("manifest_"), F.col("item")).alias("check_id"),
        F.when(F.col("rows") == F.col("value"), 0).otherwise(1).cast("long").alias("bad_rows"),
        # Files and bytes depend on the layout; their check counts as one row.
        F.when(F.col("item").rlike("^(files|bytes|shards)_"), F.lit(1).cast("long"))
        .otherwise(F.col("rows")).alias("total_rows"),
    )
    return equal.unionByName(
        _orphans("match_has_events", t.matches, t.phase_events, "match_id")
    ).unionByName(_orphans("match_has_frames", t.matches, t.phase_frames, "match_id"))


def run_checks(t) -> DataFrame:
    """Every definitional check of one build.

    A few at a time, their few rows written: in one plan dozens of scans would start at once, and
    the driver would plan all of it anew whenever a stage ends.
    """
    rows = [
        phase_checks(t.phases),
        event_checks(t.phase_events),
        frame_checks(t.phase_frames),
        vector_checks(t.similarity),
    ]
    links, spark = _link_parts(t), t.phases.sparkSession
    groups = [rows, *[links[i : i + CHECKS_AT_ONCE] for i in range(0, len(links), CHECKS_AT_ONCE)]]
    done = [
        storage.save(reduce(DataFrame.unionByName, g).coalesce(1), storage.new_path(spark, "checks"))
        for g in groups
    ]
    return reduce(DataFrame.unionByName, done).withColumn("passed", F.col("bad_rows") == 0)
