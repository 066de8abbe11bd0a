"""Match-event view over the generic ``events`` table.

Maps the (event_id, ts, user_id) rows onto flat match events by integer arithmetic, so every
operator has input that grows with the given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions.geometry import lookup
from phasegrid.functions.scan import ordered_scan
from phasegrid.sources import storage

COMPETITIONS = ("Cup A", "Cup B")


def range_blocks(spark: SparkSession, events: DataFrame, path: str) -> DataFrame:
    """Range-sort the rows by (match, ts, event) and name each slice.

    The slices follow row counts, not matches, so one huge match spreads over many of them.  The
    slice number depends on sampled bounds, hence the written table.
    """
    rows = events.count()
    slices = max(8, -(-rows // storage.ROWS_PER_BLOCK))
    ordered = (
        events.select("event_id", "ts", (F.col("user_id") % 40 + 1000).alias("match_id"))
        .repartitionByRange(slices, "match_id", "ts", "event_id")
        .withColumn("slice", F.spark_partition_id())
    )
    return storage.save(ordered, path)


def _dbl(expr: str, divisor: int) -> str:
    return f"CAST({expr} AS DOUBLE) / CAST({divisor} AS DOUBLE)"


def flat_events(spark: SparkSession, ordered: DataFrame) -> DataFrame:
    """Flat events of the view (same columns as ``sources.raw_json.flatten_events``)."""
    # (ts, event_id) is the order inside a slice; the struct keeps it one sortable column.
    ranked = ordered_scan(
        ordered.withColumn("pos", F.struct("ts", "event_id")),
        ["match_id"],
        "pos",
        sums={
            "idx": F.lit(1),
            "breaks": F.expr("CASE WHEN (event_id * 7919) % 13 < 3 THEN 1 ELSE 0 END"),
        },
        totals={"n_match": F.lit(1)},
        block="slice",
    )
    # Period borders are closed forms of the match size, so no further window is needed.
    borders = {
        "b1": "n_match * 9 DIV 20",
        "b2": "n_match * 18 DIV 20",
        "b3": "n_match * 19 DIV 20",
        "b4": "n_match * 99 DIV 100",
    }
    clock = ranked.withColumns({k: F.expr(v) for k, v in borders.items()}).withColumns(
        {
            "period": F.expr(
                "CASE WHEN idx <= b1 THEN 1 WHEN idx <= b2 THEN 2 WHEN idx <= b3 THEN 3"
                " WHEN idx <= b4 THEN 4 ELSE 5 END"
            ),
            "possession": F.expr("1 + breaks"),
            "k": F.expr("(event_id * 7907) % 100"),
        }
    )
    start = "CASE period WHEN 1 THEN 0 WHEN 2 THEN b1 WHEN 3 THEN b2 WHEN 4 THEN b3 ELSE b4 END"
    # A period's size is its own border difference, even when an earlier period is empty.
    stop = "CASE period WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 WHEN 4 THEN b4 ELSE n_match END"
    clock = clock.withColumns(
        {"pidx": F.expr(f"idx - ({start})"), "n_period": F.expr(f"({stop}) - ({start})")}
    )
    typed = clock.withColumns(
        {
            "type_id": F.expr(
                "CAST(CASE WHEN pidx <= 2 THEN 18 WHEN pidx > n_period - 2 THEN 34"
                " WHEN k < 30 THEN 30 WHEN k < 46 THEN 42 WHEN k < 60 THEN 43 WHEN k < 72 THEN 17"
                " WHEN k < 78 THEN 2 WHEN k < 82 THEN 4 WHEN k < 85 THEN 6 WHEN k < 87 THEN 9"
                " WHEN k < 89 THEN 23 WHEN k < 91 THEN 14 WHEN k < 94 THEN 16 WHEN k < 95 THEN 10"
                " WHEN k < 96 THEN 38 WHEN k < 97 THEN 21 WHEN k < 98 THEN 22 WHEN k < 99 THEN 19"
                " ELSE CASE WHEN event_id % 3 = 0 THEN 20 ELSE 3 END END AS INT)"
            ),
            "poss_side": F.expr(
                "CASE WHEN (possession * 31) % 3 < 2 THEN possession % 2"
                " ELSE (possession + 1) % 2 END"
            ),
        }
    )
    sided = typed.withColumns(
        {
            "act_side": F.expr(
                "CASE WHEN type_id = 17 THEN"
                " CASE WHEN event_id % 10 = 0 THEN poss_side ELSE 1 - poss_side END"
                " WHEN type_id IN (2, 4, 6, 9, 10, 20, 21, 22, 23) THEN (event_id * 3) % 2"
                " ELSE poss_side END"
            ),
            "x": F.expr(
                "CASE WHEN type_id IN (18, 34, 19) THEN NULL ELSE "
                + _dbl("1 + (event_id * 37) % 1200", 10) + " END"
            ),
            "y": F.expr(
                "CASE WHEN type_id IN (18, 34, 19) THEN NULL ELSE "
                + _dbl("1 + (event_id * 53) % 800", 10) + " END"
            ),
        }
    )
    pp = "(possession * 13 + match_id) % 20"
    cols = sided.selectExpr(
        "match_id",
        "CAST(idx AS INT) AS index",
        "event_id",
        "n_match",
        "concat(match_id, '-', idx) AS event_uuid",
        "CAST(period AS INT) AS period",
        "CAST(possession AS INT) AS possession",
        "match_id * 10 + poss_side AS possession_team_id",
        "match_id * 10 + act_side AS team_id",
        "concat('Team ', (match_id * 3 + poss_side * 7) % 29) AS possession_team_name",
        "concat('Team ', (match_id * 3 + act_side * 7) % 29) AS team_name",
        _dbl("pidx * 17", 10) + " AS ts_s",
        "CASE WHEN type_id = 42 THEN NULL ELSE " + _dbl("(event_id * 11) % 25", 10)
        + " END AS duration",
        "type_id",
        f"CAST(CASE WHEN {pp} < 8 THEN 1 WHEN {pp} < 17 THEN {pp} - 7 ELSE {pp} - 15 END AS INT)"
        " AS play_pattern_id",
        "CASE WHEN type_id IN (18, 34) THEN NULL"
        " ELSE (match_id * 10 + act_side) * 100 + event_id % 11 END AS player_id",
        "x",
        "y",
        "CASE WHEN type_id IN (30, 43, 16) THEN " + _dbl("1 + (event_id * 41) % 1200", 10)
        + " END AS end_x",
        "CASE WHEN type_id IN (30, 43, 16) THEN " + _dbl("1 + (event_id * 59) % 800", 10)
        + " END AS end_y",
        "CASE WHEN type_id = 16 THEN " + _dbl("event_id % 25", 10) + " END AS end_z",
        "CAST(CASE WHEN type_id = 16 THEN 96 + event_id % 6"
        " WHEN type_id = 30 AND event_id % 5 = 0 THEN"
        " CASE event_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 75 WHEN 2 THEN 76 ELSE 77 END"
        " WHEN type_id = 42 AND event_id % 8 = 0 THEN 9 WHEN type_id = 14 THEN 8 + event_id % 2"
        " WHEN type_id = 10 THEN CASE WHEN event_id % 2 = 0 THEN 4 ELSE 13 END"
        " WHEN type_id = 4 THEN CASE WHEN event_id % 3 = 0 THEN 16 ELSE 13 END END AS INT)"
        " AS outcome_id",
        "CAST(CASE WHEN type_id = 4 THEN 10 + event_id % 2 WHEN type_id = 23 THEN 25 + event_id % 9"
        " WHEN type_id = 30 AND event_id % 40 = 7 THEN 61 + event_id % 7 END AS INT) AS sub_type_id",
        "CASE WHEN type_id = 16 THEN " + _dbl("1 + (event_id * 67) % 95", 100) + " END AS xg",
        "event_id % 5 = 0 AS under_pressure",
        "event_id % 7 = 0 AS counterpress",
        "event_id % 23 = 0 AS is_out",
        "type_id = 30 AND event_id % 97 = 0 AS pass_switch",
        "false AS recovery_failure",
        "false AS save_block",
        "type_id = 30 AND event_id % 17 = 0 AS cross",
        "type_id = 30 AND event_id % 29 = 0 AS through_ball",
        "type_id = 30 AND event_id % 4 = 1 AS high_pass",
        "type_id = 30 AND event_id % 6 = 2 AS head_pass",
        "type_id = 30 AND event_id % 19 = 3 AS aerial_won",
        "event_id % 8 <> 0 AS frame_drawn",
        "CASE WHEN event_id % 3 = 0 AND idx < n_match THEN array(concat(match_id, '-', idx + 1))"
        " WHEN event_id % 5 = 0 AND idx > 1 THEN array(concat(match_id, '-', idx - 1)) END"
        " AS related_events",
    )
    base_minute = {1: 0, 2: 45, 3: 90, 4: 105, 5: 120}
    return cols.withColumns(
        {
            "type_name": lookup(F.col("type_id"), K.EVENT_TYPES),
            "minute": lookup(F.col("period"), base_minute) + F.floor(F.col("ts_s") / 60).cast("int"),
            "second": (F.floor("ts_s") % 60).cast("int"),
            "player_name": F.concat(F.lit("Player "), F.col("player_id")),
            "position_name": F.concat(F.lit("Position "), F.col("player_id") % 11),
            "outcome_name": F.when(F.col("outcome_id") == K.SHOT_GOAL, "Goal").otherwise(
                F.concat(F.lit("Outcome "), F.col("outcome_id"))
            ),
        }
    )


def flat_frames(flat: DataFrame) -> DataFrame:
    """Freeze frames of the view: 3 to 6 dots, with every orientation case present."""
    dot = (
        "CASE WHEN i = 0 THEN CASE event_id % 40"
        " WHEN 3 THEN {m} - {c} WHEN 4 THEN {m} - {c} + CAST(0.5 AS DOUBLE) ELSE {c} END"
        " ELSE CAST((event_id * {a} + i * {b}) % {n} AS DOUBLE) / CAST(10 AS DOUBLE) END"
    )
    px = dot.format(m="CAST(120.1 AS DOUBLE)", c="x", a=13, b=211, n=1200)
    py = dot.format(m="CAST(80.1 AS DOUBLE)", c="y", a=17, b=307, n=800)
    actor = (
        "CASE event_id % 40 WHEN 5 THEN false WHEN 6 THEN i < 2 ELSE i = 0 END"
    )
    return flat.filter("frame_drawn AND x IS NOT NULL").selectExpr(
        "match_id",
        "event_uuid",
        "event_id",
        "transform(sequence(0, CAST(2 + event_id % 4 AS INT)), i -> struct("
        "(i + event_id) % 2 = 0 AS teammate,"
        f" {actor} AS actor, i = 2 AS keeper,"
        f" CASE WHEN i = 3 AND event_id % 11 = 0 THEN NULL ELSE array({px}, {py}) END AS location"
        ")) AS freeze_frame",
        "array(CAST(120 AS DOUBLE), CAST(80 AS DOUBLE), CAST(event_id % 100 AS DOUBLE),"
        " CAST(10 AS DOUBLE), CAST(120 AS DOUBLE), CAST(80 AS DOUBLE)) AS visible_area",
    )


def match_dimension(flat: DataFrame) -> DataFrame:
    """One row per match of the view, in the match-table shape."""
    name = "concat('Team ', (match_id * 3 + {} * 7) % 29)"
    return flat.select("match_id").distinct().selectExpr(
        "match_id",
        "55 AS competition_id",
        "1 AS season_id",
        "CASE WHEN match_id % 2 = 0 THEN 'Cup A' ELSE 'Cup B' END AS competition",
        "'2024-01-01' AS match_date",
        "CAST(NULL AS STRING) AS kick_off",
        "'Group Stage' AS stage",
        "CAST(1 AS INT) AS match_week",
        "match_id * 10 AS home_team_id",
        f"{name.format(0)} AS home_team_name",
        "match_id * 10 + 1 AS away_team_id",
        f"{name.format(1)} AS away_team_name",
        "CAST(match_id % 4 AS INT) AS home_score",
        "CAST(match_id % 3 AS INT) AS away_score",
        "CAST(NULL AS STRING) AS stadium",
        "CAST(NULL AS STRING) AS referee",
        f"concat({name.format(0)}, ' ', match_id % 4, '–', match_id % 3, ' ', {name.format(1)},"
        " ' · ', CASE WHEN match_id % 2 = 0 THEN 'Cup A' ELSE 'Cup B' END, ' Group Stage') AS label",
    )
