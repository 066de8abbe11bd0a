"""Nested match-event JSON: declared schemas, scans and flattening."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import geometry as G

NAMED = "struct<id: int, name: string>"
EVENT_SCHEMA = (
    "id string, index bigint, period int, timestamp string, minute int, second int,"
    f" type {NAMED}, possession int, possession_team {NAMED}, team {NAMED},"
    f" play_pattern {NAMED}, duration double, player struct<id: bigint, name: string>,"
    f" position {NAMED}, location array<double>, under_pressure boolean, counterpress boolean,"
    " out boolean, related_events array<string>,"
    f" pass struct<end_location: array<double>, type: {NAMED}, outcome: {NAMED},"
    f" switch: boolean, cross: boolean, through_ball: boolean, height: {NAMED},"
    f" body_part: {NAMED}, aerial_won: boolean>,"
    " carry struct<end_location: array<double>>,"
    f" shot struct<{K.XG_FIELD}: double, end_location: array<double>, outcome: {NAMED}>,"
    f" goalkeeper struct<type: {NAMED}, outcome: {NAMED}, end_location: array<double>>,"
    f" duel struct<type: {NAMED}, outcome: {NAMED}>,"
    f" interception struct<outcome: {NAMED}>, dribble struct<outcome: {NAMED}>,"
    f" ball_receipt struct<outcome: {NAMED}>, `50_50` struct<outcome: {NAMED}>,"
    f" substitution struct<outcome: {NAMED}>,"
    " ball_recovery struct<recovery_failure: boolean>, block struct<save_block: boolean>"
)
FRAME_SCHEMA = (
    "event_uuid string, visible_area array<double>, freeze_frame array<struct<"
    "teammate: boolean, actor: boolean, keeper: boolean, location: array<double>>>"
)
MATCH_SCHEMA = (
    "match_id bigint, match_date string, kick_off string,"
    f" competition_stage {NAMED}, match_week int,"
    " home_team struct<home_team_id: int, home_team_name: string>,"
    " away_team struct<away_team_id: int, away_team_name: string>,"
    " home_score int, away_score int, stadium struct<name: string>, referee struct<name: string>"
)

# ``<match>.json``, or any file in a folder ``<match>`` or ``match_id=<match>``; seasons likewise.
MATCH_IN_PATH = r"/(?:match_id=)?(\d+)(?:\.json|/[^/]+)$"
SEASON_IN_PATH = r"/(?:competition_id=)?(\d+)/(?:season_id=)?(\d+)(?:\.json|/[^/]+)$"

# Sub-objects that carry an outcome, by event type.
_WITH_OUTCOME = (
    K.PASS, K.SHOT, K.GOALKEEPER, K.DUEL, K.INTERCEPTION, K.DRIBBLE, K.BALL_RECEIPT,
    K.FIFTY_FIFTY, 19,
)
_WITH_TYPE = (K.PASS, K.GOALKEEPER, K.DUEL)


def _sub(type_id: int, path: str) -> Column:
    return F.col(f"`{K.SUB_OBJECTS[type_id]}`.{path}")


def by_type(type_ids, path: str) -> Column:
    """Value at ``path`` of the sub-object that belongs to the event's own type."""
    expr = None
    for t in type_ids:
        cond = F.col("type.id") == t
        expr = (F.when if expr is None else expr.when)(cond, _sub(t, path))
    return expr


def _scan(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    # One array per file is the source layout; JSON lines also split within a file.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("recursiveFileLookup", "true")
        .json(path)
        .withColumns(
            {
                "match_id": F.regexp_extract(F.col("_metadata.file_path"), MATCH_IN_PATH, 1).cast("long"),
                # Rows of a file in their order: by split, then as the split's task reads them.
                "_place": place,
            }
        )
    )


def read_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested events; ``match_id`` comes from the file name or its folder."""
    return _scan(spark, path, EVENT_SCHEMA, lines).drop("_place")


def read_frames(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested freeze frames, the last one in the file of each event; ``match_id`` as for events."""
    frame = F.struct("visible_area", "freeze_frame")
    return (
        _scan(spark, path, FRAME_SCHEMA, lines)
        .groupBy("match_id", "event_uuid")
        .agg(F.max_by(frame, "_place").alias("f"))
        .select("event_uuid", "f.visible_area", "f.freeze_frame", "match_id")
    )


def read_matches(
    spark: SparkSession, path: str, competitions: Mapping[tuple[int, int], str], lines: bool = False
) -> DataFrame:
    """Match list; competition and season ids come from ``.../<competition>/<season>.json`` or from
    folders of those names."""
    ids = F.col("_metadata.file_path")
    raw = (
        spark.read.schema(MATCH_SCHEMA)
        .option("multiLine", not lines)
        .option("recursiveFileLookup", "true")
        .json(path)
        .withColumns(
            {
                "competition_id": F.regexp_extract(ids, SEASON_IN_PATH, 1).cast("int"),
                "season_id": F.regexp_extract(ids, SEASON_IN_PATH, 2).cast("int"),
            }
        )
    )
    key = F.concat_ws("/", "competition_id", "season_id")
    names = {f"{c}/{s}": label for (c, s), label in competitions.items()}
    return flatten_matches(raw.withColumn("competition", G.lookup(key, names)))


def flatten_matches(raw: DataFrame) -> DataFrame:
    stage = F.coalesce(
        G.lookup(F.col("competition_stage.id"), K.STAGES), F.col("competition_stage.name")
    )
    return raw.select(
        "match_id",
        "competition_id",
        "season_id",
        "competition",
        "match_date",
        "kick_off",
        stage.alias("stage"),
        "match_week",
        F.col("home_team.home_team_id").cast("long").alias("home_team_id"),
        "home_team.home_team_name",
        F.col("away_team.away_team_id").cast("long").alias("away_team_id"),
        "away_team.away_team_name",
        "home_score",
        "away_score",
        F.col("stadium.name").alias("stadium"),
        F.col("referee.name").alias("referee"),
    ).withColumn("label", match_label())


def match_label() -> Column:
    """``Home h–a Away · Competition Stage``."""
    return F.format_string(
        "%s %d–%d %s · %s %s",
        "home_team_name", "home_score", "away_score", "away_team_name", "competition", "stage",
    )


def flatten_events(raw: DataFrame) -> DataFrame:
    """Nested events -> the flat event columns every operator uses."""
    end = by_type(K.END_LOCATION_TYPES, "end_location")
    is_pass = F.col("type.id") == K.PASS

    def at(array: Column, i: int) -> Column:
        return F.try_element_at(array, F.lit(i))

    def pass_fact(cond: Column) -> Column:
        return is_pass & F.coalesce(cond, F.lit(False))

    return raw.select(
        "match_id",
        "index",
        F.col("id").alias("event_uuid"),
        "period",
        "possession",
        F.col("possession_team.id").cast("long").alias("possession_team_id"),
        F.col("team.id").cast("long").alias("team_id"),
        F.col("possession_team.name").alias("possession_team_name"),
        F.col("team.name").alias("team_name"),
        G.clock_seconds(F.col("timestamp")).alias("ts_s"),
        "duration",
        F.col("type.id").alias("type_id"),
        F.col("type.name").alias("type_name"),
        F.col("play_pattern.id").alias("play_pattern_id"),
        F.col("player.id").alias("player_id"),
        F.col("player.name").alias("player_name"),
        F.col("position.name").alias("position_name"),
        at(F.col("location"), 1).alias("x"),
        at(F.col("location"), 2).alias("y"),
        at(end, 1).alias("end_x"),
        at(end, 2).alias("end_y"),
        at(end, 3).alias("end_z"),
        by_type(_WITH_OUTCOME, "outcome.id").alias("outcome_id"),
        by_type(_WITH_OUTCOME, "outcome.name").alias("outcome_name"),
        by_type(_WITH_TYPE, "type.id").alias("sub_type_id"),
        F.when(F.col("type.id") == K.SHOT, F.col(f"shot.{K.XG_FIELD}")).alias("xg"),
        G.flag(F.col("under_pressure")).alias("under_pressure"),
        G.flag(F.col("counterpress")).alias("counterpress"),
        G.flag(F.col("out")).alias("is_out"),
        pass_fact(F.col("pass.switch")).alias("pass_switch"),
        G.flag(F.col("ball_recovery.recovery_failure")).alias("recovery_failure"),
        G.flag(F.col("block.save_block")).alias("save_block"),
        pass_fact(F.col("pass.cross")).alias("cross"),
        pass_fact(F.col("pass.through_ball")).alias("through_ball"),
        pass_fact(F.col("pass.height.name") == "High Pass").alias("high_pass"),
        pass_fact(F.col("pass.body_part.name") == "Head").alias("head_pass"),
        pass_fact(F.col("pass.aerial_won")).alias("aerial_won"),
        "minute",
        "second",
        "related_events",
    )


def nest_events(flat: DataFrame) -> DataFrame:
    """Flat events -> the nested source shape (inverse of ``flatten_events``)."""

    def named(i: str, n: str | None = None) -> Column:
        name = F.col(n) if n else F.lit(None).cast("string")
        return F.when(
            F.col(i).isNotNull(), F.struct(F.col(i).cast("int").alias("id"), name.alias("name"))
        )

    def only(t: int, *fields: Column) -> Column:
        return F.when(F.col("type_id") == t, F.struct(*fields))

    def true_or_null(c: str) -> Column:
        return F.when(F.col(c), True)

    def label(c: str, text: str) -> Column:
        return F.when(F.col(c), F.struct(F.lit(0).alias("id"), F.lit(text).alias("name")))

    end = F.when(F.col("end_x").isNotNull(), F.array_compact(F.array("end_x", "end_y", "end_z")))
    out, sub = named("outcome_id", "outcome_name").alias("outcome"), named("sub_type_id").alias("type")
    ms = F.round(F.col("ts_s") * 1000).cast("long")
    return flat.select(
        "match_id",
        F.col("event_uuid").alias("id"),
        "index",
        "period",
        F.format_string(
            "%02d:%02d:%02d.%03d",
            F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000,
        ).alias("timestamp"),
        "minute",
        "second",
        named("type_id", "type_name").alias("type"),
        "possession",
        named("possession_team_id", "possession_team_name").alias("possession_team"),
        named("team_id", "team_name").alias("team"),
        named("play_pattern_id").alias("play_pattern"),
        "duration",
        F.when(
            F.col("player_id").isNotNull(),
            F.struct(F.col("player_id").alias("id"), F.col("player_name").alias("name")),
        ).alias("player"),
        F.when(
            F.col("position_name").isNotNull(),
            F.struct(F.lit(0).alias("id"), F.col("position_name").alias("name")),
        ).alias("position"),
        F.when(F.col("x").isNotNull(), F.array("x", "y")).alias("location"),
        true_or_null("under_pressure").alias("under_pressure"),
        true_or_null("counterpress").alias("counterpress"),
        true_or_null("is_out").alias("out"),
        "related_events",
        only(
            K.PASS, end.alias("end_location"), sub, out,
            true_or_null("pass_switch").alias("switch"), true_or_null("cross").alias("cross"),
            true_or_null("through_ball").alias("through_ball"),
            label("high_pass", "High Pass").alias("height"),
            label("head_pass", "Head").alias("body_part"),
            true_or_null("aerial_won").alias("aerial_won"),
        ).alias("pass"),
        only(K.CARRY, end.alias("end_location")).alias("carry"),
        only(K.SHOT, F.col("xg").alias(K.XG_FIELD), end.alias("end_location"), out).alias("shot"),
        only(K.GOALKEEPER, sub, out, end.alias("end_location")).alias("goalkeeper"),
        only(K.DUEL, sub, out).alias("duel"),
        only(K.INTERCEPTION, out).alias("interception"),
        only(K.DRIBBLE, out).alias("dribble"),
        only(K.BALL_RECEIPT, out).alias("ball_receipt"),
        only(K.FIFTY_FIFTY, out).alias("50_50"),
        only(K.BALL_RECOVERY, true_or_null("recovery_failure").alias("recovery_failure")).alias(
            "ball_recovery"
        ),
        only(K.BLOCK, true_or_null("save_block").alias("save_block")).alias("block"),
    )


def audit_files(
    spark: SparkSession, matches: DataFrame, folders: Mapping[str, str],
    least: int = K.MIN_FRAME_FILE_BYTES,
) -> DataFrame:
    """Missing files per match and kind, and frame files too small to be real.

    ``folders`` maps a kind (``events``, ``frames``) to its folder.  Only file names and lengths
    are read; several files of one match count together.
    """
    reports = []
    for kind, folder in folders.items():
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.json")
            .option("recursiveFileLookup", "true")
            .load(folder)
            .groupBy(F.regexp_extract("path", MATCH_IN_PATH, 1).cast("long").alias("match_id"))
            .agg(F.sum("length").alias("bytes"))
        )
        missing = matches.select("match_id").join(files, "match_id", "left_anti")
        reports.append(
            missing.select(
                "match_id", F.lit(kind).alias("kind"), F.lit("missing").alias("problem"),
                F.lit(None).cast("long").alias("bytes"),
            )
        )
        if kind == "frames":
            reports.append(
                files.filter(F.col("bytes") < least)
                .join(matches.select("match_id"), "match_id", "left_semi")
                .select("match_id", F.lit(kind).alias("kind"), F.lit("stub").alias("problem"), "bytes")
            )
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out
