"""Feature row of every chain, built from algebraic aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import geometry as G
from phasegrid.functions.scan import by_shuffle
from phasegrid.operators import path as P
from phasegrid.operators.segment import CHAIN, has_ball_content, number_chains


def is_regain(ours: Column) -> Column:
    """Event that wins the ball for the chain's team."""
    t, o, s = F.col("type_id"), F.col("outcome_id"), F.col("sub_type_id")
    won = (
        ((t == K.INTERCEPTION) & o.isin(*K.WON_OUTCOMES))
        | ((t == K.DUEL) & (s == K.TACKLE) & o.isin(*K.WON_OUTCOMES))
        | ((t == K.BALL_RECOVERY) & ~G.flag(F.col("recovery_failure")))
        | ((t == K.FIFTY_FIFTY) & o.isin(*K.FIFTY_FIFTY_WON))
        | ((t == K.BLOCK) & ~G.flag(F.col("save_block")))
        | ((t == K.GOALKEEPER) & s.isin(*K.KEEPER_REGAIN_TYPES))
    )
    return ours & F.coalesce(won, F.lit(False))


def open_play_loss(type_id: Column, outcome_id: Column, sub_type_id: Column, ours: Column) -> Column:
    """Terminal event that gives the ball away in open play."""
    lost_by_us = (
        type_id.isin(K.MISCONTROL, K.DISPOSSESSED, K.ERROR, K.FOUL_COMMITTED)
        | ((type_id == K.PASS) & outcome_id.isin(K.INCOMPLETE, K.PASS_UNKNOWN))
        | (type_id.isin(K.BALL_RECEIPT, K.DRIBBLE) & (outcome_id == K.INCOMPLETE))
    )
    taken_by_them = type_id.isin(
        K.INTERCEPTION, K.BALL_RECOVERY, K.DUEL, K.BLOCK, K.CLEARANCE, K.DRIBBLED_PAST
    ) | ((type_id == K.GOALKEEPER) & sub_type_id.isin(*K.KEEPER_REGAIN_TYPES))
    return F.coalesce(F.when(ours, lost_by_us).otherwise(taken_by_them), F.lit(False))


def aggregate_chains(seg: DataFrame, thr: K.Thresholds = K.Thresholds()) -> DataFrame:
    """One row per chain with ball content.  Needs the columns of ``segment``.

    Every aggregate is a count, sum, extreme or value-at-extreme of a primitive, so map-side
    partial aggregation shrinks even a chain that holds a third of all rows.
    """
    t, o, s, i = (F.col(c) for c in ("type_id", "outcome_id", "sub_type_id", "index"))
    ours = F.col("team_id") == F.col("chain_team_id")
    admin = G.is_admin(t)
    located = F.col("x").isNotNull()
    at_path = F.when(P.on_path(ours), i)
    at_terminal = F.when(~admin & (t != K.PRESSURE), i)
    at_pass = F.when(ours & (t == K.PASS), i)
    at_regain = F.when(is_regain(ours) & located, i)
    stop = F.col("ts_s") + F.coalesce(F.col("duration"), F.lit(0.0))
    shot = ours & (t == K.SHOT)
    end_x, end_y = F.coalesce("end_x", "x"), F.coalesce("end_y", "y")
    regain_x = G.canonical_x(F.col("x"), ~ours)
    own_goal = t == K.OWN_GOAL_AGAINST
    boxed = G.in_box(F.col("x"), F.col("y")) | F.coalesce(
        G.in_box(F.col("end_x"), F.col("end_y")), F.lit(False)
    )
    long_switch = F.coalesce(F.abs(F.col("end_y") - F.col("y")) >= thr.switch_dy, F.lit(False))

    def any_of(cond: Column) -> Column:
        return F.coalesce(F.bool_or(F.coalesce(cond, F.lit(False))), F.lit(False))

    rows = seg.groupBy(*CHAIN).agg(
        has_ball_content().alias("content"),
        F.first("period").alias("period"),
        F.first("possession").alias("possession"),
        F.first("chain_team_id").alias("team_id"),
        F.first("chain_start_ts").alias("start_ts"),
        F.min_by("minute", i).alias("minute"),
        F.min_by("second", i).alias("second"),
        F.max(F.when(~admin, stop)).alias("ball_stop"),
        F.max(stop).alias("any_stop"),
        F.max_by("play_pattern_id", i).alias("play_pattern_id"),
        F.min_by(s, at_pass).alias("first_pass_type"),
        F.count("*").alias("n_events"),
        F.count_if(ours & (t == K.PASS)).alias("n_passes"),
        F.count_if(shot).alias("n_shots"),
        F.count_if(~ours & (t == K.PRESSURE)).alias("pressure_events"),
        F.min_by("x", at_path).alias("start_x"),
        F.min_by("y", at_path).alias("start_y"),
        F.max_by(end_x, at_path).alias("end_x"),
        F.max_by(end_y, at_path).alias("end_y"),
        F.max(F.when(at_path.isNotNull(), F.greatest("x", "end_x"))).alias("max_x"),
        F.min(F.when(at_path.isNotNull(), F.least("x", "end_x"))).alias("min_x"),
        F.max(F.when(at_path.isNotNull(), F.greatest("y", "end_y"))).alias("max_y"),
        F.min(F.when(at_path.isNotNull(), F.least("y", "end_y"))).alias("min_y"),
        any_of(at_path.isNotNull() & boxed).alias("reached_box"),
        any_of(shot & (o == K.SHOT_GOAL)).alias("goal_shot"),
        any_of(~ours & own_goal).alias("own_goal_for"),
        any_of(shot & o.isin(*K.SHOT_ON_TARGET)).alias("on_target"),
        any_of(~ours & (t == K.SHOT) & (o == K.SHOT_GOAL)).alias("goal_against"),
        any_of(ours & own_goal).alias("own_goal_against"),
        any_of(t == K.HALF_END).alias("half_end"),
        any_of(ours & (t == K.PASS) & (G.flag(F.col("pass_switch")) | long_switch)).alias(
            "switch_of_play"
        ),
        F.max(F.when(shot, F.coalesce("xg", F.lit(0.0)))).alias("xg"),
        F.max_by(t, at_terminal).alias("end_type"),
        F.max_by(o, at_terminal).alias("end_outcome"),
        F.max_by(s, at_terminal).alias("end_sub_type"),
        F.max_by(ours, at_terminal).alias("end_ours"),
        F.max_by(G.flag(F.col("is_out")), at_terminal).alias("end_out"),
        F.min_by(regain_x, at_regain).alias("regain_x_won"),
        F.min(at_regain).alias("regain_index"),
        F.min_by(G.flag(F.col("counterpress")), at_regain).alias("regain_press_won"),
        F.min_by(regain_x, i).alias("regain_x_first"),
        F.min_by(G.flag(F.col("counterpress")), i).alias("regain_press_first"),
        F.count_if(F.col("has_frame")).alias("n_framed"),
    )
    return rows.filter("content").drop("content")


def count_players(seg: DataFrame) -> DataFrame:
    """Distinct players of the chain's team."""
    return (
        seg.filter((F.col("team_id") == F.col("chain_team_id")) & F.col("player_id").isNotNull())
        .select(*CHAIN, "player_id")
        .distinct()
        .groupBy(*CHAIN)
        .agg(F.count("*").alias("n_players"))
    )


def presses_before(chains: DataFrame, seg: DataFrame, window_s: float) -> DataFrame:
    """``press_before``: a same-team Pressure in the closed interval [start - window, start].

    Interval existence without a range join: time is cut into cells as wide as the window, so a
    hit lies either in the start's own cell (its earliest press is not later than the start) or
    in the cell before (its latest press is not earlier than start - window).  Two extremes per
    cell decide it with one equi-join.  Scoped to (match, period).
    """
    width = int(round(window_s * 1000))
    ms = F.round(F.col("ts_s") * 1000).cast("long")
    cells = (
        seg.filter(F.col("type_id") == K.PRESSURE)
        .select("match_id", "period", "team_id", ms.alias("ms"))
        .withColumn("own_cell", F.floor(F.col("ms") / width))
        .withColumn("cell", F.explode(F.array(F.col("own_cell"), F.col("own_cell") + 1)))
        .groupBy("match_id", "period", "team_id", "cell")
        .agg(
            F.min(F.when(F.col("cell") == F.col("own_cell"), F.col("ms"))).alias("earliest_here"),
            F.max(F.when(F.col("cell") > F.col("own_cell"), F.col("ms"))).alias("latest_before"),
        )
    )
    start = F.round(F.col("start_ts") * 1000).cast("long")
    return (
        chains.withColumns({"_ms": start, "cell": F.floor(start / width)})
        .join(by_shuffle(cells), ["match_id", "period", "team_id", "cell"], "left")
        .withColumn(
            "press_before",
            F.coalesce(F.col("earliest_here") <= F.col("_ms"), F.lit(False))
            | F.coalesce(F.col("latest_before") >= F.col("_ms") - width, F.lit(False)),
        )
        .drop("_ms", "cell", "earliest_here", "latest_before")
    )


def start_type() -> Column:
    """Set-piece pattern, then first-pass type, then change of team, else ``regular``."""
    turned_over = (F.col("prev_period") == F.col("period")) & (
        F.col("prev_team_id") != F.col("team_id")
    )
    return F.coalesce(
        G.lookup(F.col("play_pattern_id"), K.PATTERN_START),
        G.lookup(F.col("first_pass_type"), K.PASS_TYPE_START),
        F.when(turned_over, "turnover_open_play").otherwise("regular"),
    )


def pattern_disagreed() -> Column:
    return F.coalesce(
        G.lookup(F.col("play_pattern_id"), K.PATTERN_START)
        != G.lookup(F.col("first_pass_type"), K.PASS_TYPE_START),
        F.lit(False),
    )


def outcome() -> Column:
    t, o, s, ours = (F.col(c) for c in ("end_type", "end_outcome", "end_sub_type", "end_ours"))
    out = (
        F.coalesce(F.col("end_out"), F.lit(False))
        | ((t == K.PASS) & o.isin(K.PASS_OUT, K.PASS_OFFSIDE))
        | (t == K.OFFSIDE)
    )
    foul = ((t == K.FOUL_WON) & ours) | ((t == K.FOUL_COMMITTED) & ~ours)
    return (
        F.when(F.col("goal_shot") | F.col("own_goal_for"), "goal")
        .when(F.col("on_target"), "shot_on_target")
        .when(F.col("n_shots") > 0, "shot_off_target")
        .when(t.isNotNull() & open_play_loss(t, o, s, ours), "lost_ball")
        .when(out, "out_of_play")
        .when(foul, "foul_won")
        .when(F.col("half_end"), "end_of_period")
        .otherwise("lost_ball")
    )


def derive(chains: DataFrame, thr: K.Thresholds = K.Thresholds()) -> DataFrame:
    """Published features and diagnostics.  Needs numbering, players and press flag joined in."""
    yards = F.col("end_x") - F.col("start_x")
    spread = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    chains = chains.withColumn("path_moved", F.coalesce(spread > P.SAME_POINT, F.lit(False)))
    filled = chains.withColumns(
        {
            "n_players": F.coalesce("n_players", F.lit(0).cast("long")),
            "start_x": F.coalesce("start_x", F.lit(60.0)),
            "start_y": F.coalesce("start_y", F.lit(40.0)),
            "end_x": F.coalesce("end_x", F.lit(60.0)),
            "end_y": F.coalesce("end_y", F.lit(40.0)),
            "max_x": F.coalesce("max_x", F.lit(60.0)),
            "end_ts": F.coalesce("ball_stop", "any_stop"),
            "xg": F.coalesce("xg", F.lit(0.0)),
            "start_type": start_type(),
            "pattern_disagreed": pattern_disagreed(),
            "outcome": outcome(),
            "goal_conceded": F.col("goal_against") | F.col("own_goal_against"),
            "regain_x": F.when(F.col("regain_index").isNull(), F.col("regain_x_first"))
            .otherwise(F.col("regain_x_won")),
            "counterpress_regain": F.coalesce(
                F.when(F.col("regain_index").isNull(), F.col("regain_press_first")).otherwise(
                    F.col("regain_press_won")
                ),
                F.lit(False),
            ),
        }
    )
    timed = filled.withColumn(
        "duration_s", F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(0.0))
    ).withColumn(
        "speed_yd",
        F.when(F.col("duration_s") > 0.05, yards / F.col("duration_s")).otherwise(F.lit(0.0)),
    )
    turnover = F.col("start_type") == "turnover_open_play"
    final_third = F.col("max_x") >= K.FINAL_THIRD_X
    high_press = (
        turnover
        & (F.col("regain_x") >= thr.high_press_x)
        & (F.col("counterpress_regain") | F.col("press_before"))
    )
    broke = (
        turnover
        & (F.col("regain_x") <= thr.counter_regain_x_max)
        & (yards >= thr.counter_progression)
        & (F.col("speed_yd") >= thr.counter_speed)
        & final_third
    )
    return timed.withColumns(
        {
            "abs_start_s": G.absolute_seconds(F.col("period"), F.col("start_ts")),
            "start_zone": G.zone(F.col("start_x"), F.col("start_y")),
            "end_zone": G.zone(F.col("end_x"), F.col("end_y")),
            "progression_m": yards * K.YARD_M,
            "direct_speed_m_s": F.col("speed_yd") * K.YARD_M,
            "reached_final_third": final_third,
            "high_press_regain": F.coalesce(high_press, F.lit(False)),
            "counterattack": F.coalesce(
                F.col("play_pattern_id") == K.PATTERN_COUNTER, F.lit(False)
            )
            | F.coalesce(broke, F.lit(False)),
            "has_360": F.col("n_framed") > 0,
            "frame_coverage": F.col("n_framed") / F.col("n_events"),
        }
    )


def build_features(
    chains: DataFrame, seg: DataFrame, thr: K.Thresholds = K.Thresholds()
) -> DataFrame:
    """Chains -> numbered, fully derived feature rows (without path and match dimension)."""
    numbered = number_chains(chains)
    pressed = presses_before(numbered, seg, thr.high_press_window_s)
    return derive(pressed.join(by_shuffle(count_players(seg)), CHAIN, "left"), thr)
