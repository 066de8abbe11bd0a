"""Named queries over one data folder: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid import constants as K
from phasegrid.functions import geometry as G
from phasegrid.functions.scan import block_of, by_shuffle
from phasegrid.operators import (
    augment as AUG,
    evaluate as E,
    frames as FR,
    path as P,
    replay as R,
    requests as REQ,
    saved as SV,
    search as S,
    similar as SIM,
    spacing,
    standing as ST,
)
from phasegrid.plans import profiling as PR, quality as Q, reports as RP
from phasegrid.plans.build import Tables, name_events, testdata_tables
from phasegrid.sources import raw_json, snapshots, storage, tables as TB
from phasegrid.sources.testdata import COMPETITIONS

Query = Callable[[SparkSession, str], DataFrame]
ENUMS = {"competition": COMPETITIONS}
COMPETITION_WORDS = (("Cup A", ("euro 2024", "euros 2024", "2024")), ("Cup B", ("2020",)))
TARGET_PHASE = "1000-0003"
SEED = 20240714

QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Whole numbers as bigint, floating numbers as doubles rounded to ``digits``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            # Adding zero turns a negative zero into zero.
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def on_tables(digits: int = 4):
    """Register a query over the built tables."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf: tidy(fn(testdata_tables(spark, sf)), digits)
        return fn

    return register


def on_folder(digits: int = 4):
    """Register a query that also needs the session and the folder."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf: tidy(fn(spark, sf), digits)
        return fn

    return register


_SAVED: dict[tuple[str, str], DataFrame] = {}


def written_once(t: Tables, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries read, written once per build."""
    key = (t.path, name)
    if key not in _SAVED:
        _SAVED[key] = storage.save(make(), storage.new_path(t.phases.sparkSession, name))
    return _SAVED[key]


# Raw feed and segmentation ---------------------------------------------------------------------


@on_tables()
def flat_events(t):
    return t.events.select(
        "match_id", "index", "event_uuid", "period", "possession", "possession_team_id", "team_id",
        "team_name", "ts_s", "minute", "second", "duration", "type_id", "type_name",
        "play_pattern_id", "player_id", "player_name", "x", "y", "end_x", "end_y", "end_z",
        "outcome_id", "outcome_name", "sub_type_id", "xg", "counterpress", "is_out",
    )


@on_tables()
def nested_json_events(t):
    """Nested JSON text of every event, parsed with the declared schema and flattened."""
    text = raw_json.nest_events(t.events)
    text = text.select("match_id", F.to_json(F.struct(*text.columns)).alias("j"))
    nested = text.select("match_id", F.from_json("j", raw_json.EVENT_SCHEMA).alias("e"))
    flat = raw_json.flatten_events(nested.select("match_id", "e.*"))
    return flat.select(
        "match_id", "index", "event_uuid", "period", "ts_s", "type_id", "outcome_id",
        "sub_type_id", "x", "y", "end_x", "end_y", "end_z", "xg", "under_pressure",
        "counterpress", "is_out", "pass_switch", "cross", "through_ball", "high_pass",
        "head_pass", "aerial_won",
    )


@on_tables()
def json_file_events(t):
    """The feed's events written as JSON files of their matches, scanned and flattened."""
    path = storage.new_path(t.phases.sparkSession, "feed-events")
    raw_json.nest_events(t.events).write.partitionBy("match_id").json(path)
    flat = raw_json.flatten_events(raw_json.read_events(t.phases.sparkSession, path, lines=True))
    return flat.select(
        "match_id", "index", "event_uuid", "period", "ts_s", "type_id", "outcome_id",
        "sub_type_id", "x", "y", "end_x", "end_y", "end_z", "xg", "under_pressure",
        "counterpress", "is_out", "pass_switch", "cross", "through_ball", "high_pass",
        "head_pass", "aerial_won",
    )


@on_tables()
def json_file_frames(t):
    """Frames written with an outdated copy before each: the last one in the file counts."""
    spark, path = t.phases.sparkSession, storage.new_path(t.phases.sparkSession, "feed-frames")
    frames = t.frames.select("match_id", "event_uuid", "visible_area", "freeze_frame")
    old = frames.withColumn("visible_area", F.array(F.lit(-1.0)))
    both = old.withColumn("_v", F.lit(0)).unionByName(frames.withColumn("_v", F.lit(1)))
    (
        both.repartition("match_id").sortWithinPartitions("match_id", "_v", "event_uuid")
        .drop("_v").write.partitionBy("match_id").json(path)
    )
    return raw_json.read_frames(spark, path, lines=True).select(
        "match_id", "event_uuid", F.size("freeze_frame").alias("dots"),
        F.col("visible_area")[2].alias("area_x"), F.col("freeze_frame")[0]["location"][0].alias("x"),
    )


@on_tables()
def json_file_matches(t):
    """The match list written as season files and read back with labels."""
    path = storage.new_path(t.phases.sparkSession, "feed-matches")
    nested = t.matches.select(
        "match_id", "match_date", "kick_off", "home_score", "away_score", "match_week",
        F.struct(F.lit(10).alias("id"), F.col("stage").alias("name")).alias("competition_stage"),
        F.struct("home_team_id", "home_team_name").alias("home_team"),
        F.struct("away_team_id", "away_team_name").alias("away_team"),
        "competition_id", (F.col("match_id") % 2).alias("season_id"),
    )
    nested.write.partitionBy("competition_id", "season_id").json(path)
    read = raw_json.read_matches(
        t.phases.sparkSession, path, {(55, 0): "Cup A", (55, 1): "Cup B"}, lines=True
    )
    return read.select(
        "match_id", "competition", "home_team_id", "home_team_name", "away_team_id",
        "away_team_name", "home_score", "away_score", "label",
    )


@on_tables()
def json_file_audit(t):
    """Matches without files and frame files too small, in a feed with such gaps."""
    spark = t.phases.sparkSession
    base = storage.new_path(spark, "feed-audit")
    last = F.col("match_id") % 10
    events = t.events.groupBy("match_id").agg(F.max("index").alias("index"))
    events.filter(last != 3).write.partitionBy("match_id").json(f"{base}/events")
    pad = F.when(last == 7, F.lit("-")).otherwise(F.repeat(F.lit("-"), 2000))
    frames = t.frames.select("match_id").distinct().withColumn("event_uuid", pad)
    frames.filter(last != 5).write.partitionBy("match_id").json(f"{base}/frames")
    folders = {"events": f"{base}/events", "frames": f"{base}/frames"}
    return raw_json.audit_files(spark, t.matches, folders, 1000).select("match_id", "kind", "problem")


@on_tables()
def match_table(t):
    return t.matches.select(
        "match_id", "competition", "home_team_id", "home_team_name", "away_team_id",
        "away_team_name", "home_score", "away_score", "label",
    )


@on_tables()
def event_geometry(t):
    """Mirrors, zones, box, clamped output and absolute clock of every located event."""
    x, y = F.col("x"), F.col("y")
    return t.events.filter(x.isNotNull()).select(
        "match_id",
        "index",
        G.mirror_x(x).alias("mirror_x"),
        G.mirror_y(y).alias("mirror_y"),
        G.mirror_x(G.mirror_x(x)).alias("back_x"),
        G.frame_mirror_x(x).alias("frame_x"),
        G.frame_mirror_y(y).alias("frame_y"),
        G.zone(x, y).alias("zone"),
        G.in_box(x, y).alias("in_box"),
        G.clamp_x(x + F.col("end_x") - 60.0).alias("clamped_x"),
        G.clamp_y(y * 1.5 - 20.0).alias("clamped_y"),
        G.absolute_seconds(F.col("period"), F.col("ts_s")).alias("abs_s"),
    )


@on_folder()
def zone_members(spark, sf):
    """Located events per zone with the zone's third, channel and rectangle."""
    t = testdata_tables(spark, sf)
    located = t.events.filter(F.col("x").isNotNull()).select(
        G.zone(F.col("x"), F.col("y")).alias("zone")
    )
    return located.groupBy("zone").agg(F.count("*").alias("n")).join(
        G.zone_dimension(spark), "zone"
    )


@on_folder()
def type_vocabulary(spark, sf):
    """Events per type with the type's vocabulary index."""
    t = testdata_tables(spark, sf)
    return (
        t.events.groupBy("type_id")
        .agg(F.count("*").alias("n"))
        .join(TB.event_types(spark), "type_id", "left")
        .select("type_id", "type_name", "n", F.coalesce("type_index", F.lit(0)).alias("type_index"))
    )


@on_tables()
def segmented_events(t):
    return t.segmented.select(
        "match_id", "index", "start_index", "idx", "chain_team_id",
        (F.col("ts_s") - F.col("chain_start_ts")).alias("t_offset"), "has_frame",
    )


@on_tables()
def chain_diagnostics(t):
    return t.chains.select(
        "match_id", "seq", "start_index", "period", "possession", "team_id", "prev_team_id",
        "prev_period", "play_pattern_id", "first_pass_type", "end_type", "regain_x",
        "pattern_disagreed", "counterpress_regain", "press_before", "path_moved", "speed_yd",
    )


# The published tables ----------------------------------------------------------------------------


@on_tables()
def phase_table(t):
    return t.phases.drop("path_xy", "start_index")


@on_tables(3)
def phase_paths(t):
    """Every sample point of every path."""
    return t.phases.select("phase_id", F.posexplode("path_xy").alias("at", "value"))


@on_tables(3)
def spaced_path(t):
    """Path points over 5.05 yards from the last point kept, folded in blocks of four events."""
    points = P.path_points(
        name_events(t.segmented, t.chains), ["phase_id"], F.col("team_id") == F.col("chain_team_id")
    )
    short = points.withColumn("block", block_of(F.col("pos"), 3))
    return spacing.kept_points(short, ["phase_id"], 5.05).drop("block")


@on_tables()
def phase_events(t):
    return t.phase_events.drop("bucket")


@on_tables()
def phase_frame_dots(t):
    """Every canonical dot of every frame."""
    dots = F.arrays_zip("px", "py", "flags")
    return t.phase_frames.select(
        "phase_id", "idx", "event_uuid", "orientation", "n_players", F.posexplode(dots).alias("dot", "d")
    ).select(
        "phase_id", "idx", "event_uuid", "orientation", "n_players", "dot",
        F.col("d.px").alias("px"), F.col("d.py").alias("py"), F.col("d.flags").alias("flags"),
    )


@on_tables()
def phase_frame_areas(t):
    return t.phase_frames.select(
        "phase_id", "idx", F.posexplode("visible_area").alias("at", "value")
    )


@on_tables(5)
def phase_vectors(t):
    return t.similarity.select("phase_id", F.posexplode("vec").alias("dim", "value"))


@on_tables(5)
def feature_moments(t):
    return SIM.moments(t.phases)


@on_tables()
def one_phase_rows(t):
    return TB.phase_rows(t.phase_events, 1000, TARGET_PHASE).select(
        "phase_id", "idx", "event_uuid", "type_name", "t_offset_s", "x", "y"
    )


@on_tables()
def several_match_rows(t):
    return TB.match_rows(t.phase_events, [1001, 1003, 1007])


@on_tables()
def first_match_events(t):
    """Events of the first five matches."""
    chosen = TB.first_matches(t.matches, 5)
    return TB.only_matches(t.events, chosen).groupBy("match_id").agg(F.count("*").alias("n"))


@on_tables()
def match_splits(t):
    """Phases per split of a hash-assigned split table."""
    splits = TB.assign_splits(t.matches, SEED)
    return TB.split_of(t.phases, splits).groupBy("split", "match_id").agg(
        F.count("*").alias("phases")
    )


@on_tables()
def build_manifest(t):
    """The stored manifest without what depends on the layout."""
    return RP.stored_manifest(t).filter(~F.col("item").rlike("^(files|bytes|shards)_"))


@on_tables()
def phase_group_sizes(t):
    return RP.group_sizes(t.phase_events)


# Search ------------------------------------------------------------------------------------------


def _search(name: str, query: dict, **options) -> None:
    def run(spark, sf):
        t = testdata_tables(spark, sf)
        found = S.search(t.phases, query, enums=ENUMS, **options)
        return tidy(found.drop("path_xy"))

    QUERIES[name] = run


for _name, _query in S.PRESETS.items():
    _search("search_" + _name.replace("-", "_"), _query)


def _f(field, op, value):
    return {"field": field, "op": op, "value": value}


SEARCHES = {
    "search_everything": {"filters": []},
    "search_flagship": {"filters": [_f("progression_m", "gte", 0)]},
    "search_between": {
        "filters": [_f("duration_s", "between", [2, 15.5]), _f("minute", "between", [10, 80])],
        "order_by": {"field": "duration_s", "dir": "asc"}, "limit": 96,
    },
    "search_sets": {
        "filters": [
            _f("start_type", "in", ["corner", "free_kick", "throw_in"]),
            _f("outcome", "neq", "lost_ball"), _f("competition", "eq", "Cup A"),
            _f("n_passes", "lte", 12), _f("period", "in", [1, 2, 3]),
        ],
        "order_by": {"field": "n_passes", "dir": "desc"}, "limit": 500,
    },
    "search_scalars": {
        "filters": [
            _f("has_360", "eq", True), _f("counterattack", "neq", True), _f("xg", "lte", 0.1),
            _f("frame_coverage", "gte", 0.5), _f("start_zone", "neq", "def_third_left"),
        ],
        "order_by": {"field": "progression_m", "dir": "asc"}, "limit": 1,
    },
}
for _name, _query in SEARCHES.items():
    _search(_name, _query)


@on_tables()
def search_extra_predicate(t):
    """A search narrowed by the caller, with chosen columns."""
    return S.search(
        t.phases,
        {"filters": [_f("n_events", "gte", 3)], "limit": 30},
        ("phase_id", "team_name", "xg"),
        [F.col("phase_id") != TARGET_PHASE],
        ENUMS,
    )


@on_tables()
def search_counts(t):
    """Match count of each preset."""
    out = None
    for name, query in S.PRESETS.items():
        one = S.count_matches(t.phases, query, enums=ENUMS).select(F.lit(name).alias("preset"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@on_tables()
def phase_lookup(t):
    return S.phase_by_id(t.phases, TARGET_PHASE).drop("path_xy")


@on_tables()
def team_vocabulary(t):
    return S.vocabulary(t.phases, "team_name")


@on_tables()
def vocabulary_search(t):
    return S.search_vocabulary(
        S.vocabulary(t.phases, "team_name"), "team_name", " TEAM 1", ("Team 25",)
    )


@on_tables()
def competition_vocabulary(t):
    return S.vocabulary(t.phases, "competition")


@on_tables()
def search_many(t):
    """All presets and sample searches in one scan."""
    return S.search_many(t.phases, {**S.PRESETS, **SEARCHES}, enums=ENUMS)


@on_tables()
def standing_queries(t):
    """One saved query for every phase (its like: start, outcome, passes, progression), all matched at
    once: how many phases meet each, and the first of them."""
    def f(field, op, *values):
        texts = F.array(*[v.cast("string") for v in values])
        return F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), texts.alias("values"))

    near = F.round(F.col("progression_m").cast("double"))
    saved = t.phases.select(
        F.col("phase_id").alias("query_id"),
        F.array(
            f("start_type", "eq", F.col("start_type")), f("outcome", "neq", F.col("outcome")),
            f("n_passes", "gte", F.col("n_passes")), f("progression_m", "between", near - 5, near + 5),
            f("reached_box", "eq", F.col("reached_box")),
        ).alias("filters"),
    )
    return ST.match_saved(t.phases, saved).groupBy("query_id").agg(
        F.count("*").alias("n_matches"), F.min("phase_id").alias("first_phase")
    )


def pinned(t: Tables) -> DataFrame:
    """Report sections derived from the phase table: shots pinned, some twice, some missing."""
    shots = t.phases.filter(F.col("n_shots") > 0)
    row = [
        F.concat(F.lit("s"), F.col("seq") % 5).alias("section"),
        F.col("seq").alias("ordinal"),
        "phase_id",
    ]
    again = shots.filter(F.col("seq") % 3 == 0).select(
        F.lit("s9").alias("section"), F.col("seq").alias("ordinal"), "phase_id"
    )
    gone = shots.filter(F.col("seq") % 4 == 0).select(
        F.lit("s7").alias("section"),
        F.col("seq").alias("ordinal"),
        F.concat(F.lit("gone-"), F.col("phase_id")).alias("phase_id"),
    )
    return shots.select(*row).unionByName(again).unionByName(gone)


@on_tables()
def report_phases(t):
    return S.pinned_phases(t.phases, pinned(t)).select(
        "section", "ordinal", "phase_id", "team_name", "outcome", "xg"
    )


@on_tables()
def report_missing(t):
    return S.missing_pins(t.phases, pinned(t))


@on_tables()
def report_summary(t):
    return S.summarize(t.phases, pinned(t))


# Requests and saved queries ----------------------------------------------------------------------

REQUEST_TEXT = """
CASE seq % 7
 WHEN 0 THEN 'Top ' || (1 + seq % 120) || ' fastest counterattacks by ' || team_name || ' against ' || opponent_name
 WHEN 1 THEN 'High turnovers leading to a shot under ' || (5 + seq % 20) || ' seconds'
 WHEN 2 THEN 'the best chances of ' || team_name || ' from corners with at least ' || (seq % 9) || ' passes'
 WHEN 3 THEN 'Long patient build-up starting wide in the middle third, ' || team_name || ' 2024'
 WHEN 4 THEN 'Goals from a free kick by Cristiano Ronaldo in the final'
 WHEN 5 THEN 'quick  switches starting centrally in the defensive third over ' || (2 + seq % 9) || '.5 seconds while pressed'
 ELSE replace(outcome, '_', ' ') || ' after a ' || replace(start_type, '_', ' ') || ' that reached the final third – ' || team_name || ' vs ' || opponent_name
END
"""


def request_log(t: Tables) -> DataFrame:
    return t.phases.selectExpr("phase_id AS request_id", f"{REQUEST_TEXT} AS text")


def teams(t: Tables) -> DataFrame:
    return t.phases.select("team_name").distinct()


@on_tables()
def request_filters(t):
    return REQ.matched_filters(REQ.parse_requests(request_log(t), teams(t), COMPETITION_WORDS))


@on_tables()
def request_orders(t):
    parsed = REQ.parse_requests(request_log(t), teams(t), COMPETITION_WORDS)
    return parsed.select(
        "request_id", F.size("filters").alias("n_filters"), "order_field", "order_dir",
        F.col("limit").alias("max_rows"), F.array_join("dropped", "; ").alias("dropped"),
    )


@on_folder()
def conversation_requests(spark, sf):
    """Every conversation turn read as a request."""
    t = testdata_tables(spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), "text"
    )
    parsed = REQ.parse_requests(turns, teams(t), COMPETITION_WORDS)
    return parsed.select(
        "request_id", F.size("filters").alias("n_filters"),
        F.array_join("filters.field", ",").alias("fields"), F.size("dropped").alias("n_dropped"),
    )


def saved_queries(t: Tables) -> DataFrame:
    """Saved queries derived from the phase table, with repeated and mergeable filters."""
    return t.phases.selectExpr(
        "phase_id AS query_id",
        """array(
          named_struct('field', 'counterattack', 'op', IF(seq % 2 = 0, 'eq', 'neq'), 'values', array(IF(seq % 3 = 0, 'true', 'false'))),
          named_struct('field', 'start_zone', 'op', 'in', 'values',
            CASE seq % 4 WHEN 0 THEN array('def_third_left', 'def_third_centre', 'def_third_right')
              WHEN 1 THEN array('mid_third_left') WHEN 2 THEN array('def_third_left', 'mid_third_left', 'final_third_left', 'final_third_centre')
              ELSE array('def_third_left', 'mid_third_centre', 'final_third_right', 'mid_third_right') END),
          named_struct('field', 'n_passes', 'op', 'gte', 'values', array(CAST(n_passes AS STRING))),
          named_struct('field', 'n_passes', 'op', 'lte', 'values', array(concat(n_passes + 3, '.5'))),
          named_struct('field', 'period', 'op', 'eq', 'values', array(CAST(period AS STRING))),
          named_struct('field', 'duration_s', 'op', IF(seq % 5 = 0, 'between', 'gte'), 'values',
            IF(seq % 5 = 0, array('2.25', '30.0'), array('7.125'))),
          named_struct('field', 'outcome', 'op', 'eq', 'values', array(outcome)),
          named_struct('field', 'team_name', 'op', 'neq', 'values', array('Team 3')),
          named_struct('field', 'match_id', 'op', 'eq', 'values', array(CAST(38693780 + seq % 2 AS STRING))),
          named_struct('field', 'team_name', 'op', 'in', 'values',
            IF(seq % 2 = 0, array('A,B', 'C'), array('A', 'B,C'))),
          named_struct('field', 'end_zone', 'op', 'in', 'values',
            array('mid_third_left', 'def_third_right', 'def_third_right')))
        AS filters""",
        "IF(seq % 3 = 0, 'xg', NULL) AS order_field",
        "IF(seq % 3 = 0, IF(seq % 2 = 0, 'asc', 'desc'), NULL) AS order_dir",
    )


@on_tables()
def saved_canonical(t):
    return (
        SV.canonicalize(saved_queries(t))
        .select("query_id", F.posexplode("filters").alias("at", "f"))
        .select("query_id", "at", "f.field", "f.op", F.array_join("f.values", ",").alias("values"))
    )


# Operators and values that the validation query goes through, one for each phase in turn.
TRIED_OPS = ("eq", "neq", "in", "gte", "lte", "between", "like")
TRIED_VALUES = (
    ["12"], ["1.5"], ["true"], ["mid_third_left"], [], ["1", "5"], ["5", "1"], ["NaN"], ["1e400"], ["x", None], None, ["Team 1"],
)


def tried_queries(t: Tables) -> DataFrame:
    """A query for every phase: a sound filter of its own, then one of any field, operator and value."""
    def turn(values, place, kind):
        lists = F.array(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast(kind) for v in values])
        return F.element_at(lists, (place % len(values) + 1).cast("int"))

    seq = F.col("seq")
    tried = F.struct(
        turn([*S.FIELDS, "nothing"], seq, "string").alias("field"), turn(TRIED_OPS, F.floor(seq / 3), "string").alias("op"),
        turn(TRIED_VALUES, F.floor(seq / 2) + F.col("match_id"), "array<string>").alias("values"),
    )
    sound = F.struct(
        F.lit("n_passes").alias("field"), F.lit("gte").alias("op"), F.array(F.col("n_passes").cast("string")).alias("values")
    )
    return t.phases.select(
        F.col("phase_id").alias("query_id"), F.array(sound, tried).alias("filters"),
        turn([None, "xg", "outcome", "minute", None], seq, "string").alias("order_field"),
        turn([None, "asc", "down", None, "desc", "desc"], seq, "string").alias("order_dir"),
    )


@on_tables()
def saved_errors(t):
    """Path of the first fault of every query, null where it is accepted."""
    return SV.query_errors(tried_queries(t), ENUMS).select("query_id", "error")


@on_tables()
def saved_groups(t):
    """Saved queries that ask the same question."""
    groups = SV.group_by_key(SV.canonicalize(saved_queries(t)))
    return groups.select("query_key", "n_saved", "first_query")


@on_tables()
def saved_phrases(t):
    return SV.describe(saved_queries(t)).select(
        "query_id", F.array_join("phrases", " / ").alias("phrases"), "order_text"
    )


# Charts, calibration, definition tables ----------------------------------------------------------

def _on_phases(report: Callable[[DataFrame], DataFrame], digits: int = 4) -> None:
    """Register a report over the phase table under its own name."""
    QUERIES[report.__name__] = lambda spark, sf: tidy(
        report(testdata_tables(spark, sf).phases), digits
    )


for _report in (
    RP.xg_histogram, RP.duration_progression_grid, RP.regain_deciles, RP.regain_bands,
    RP.regain_value, RP.flag_totals, RP.competition_counts, RP.phases_per_match,
):
    _on_phases(_report)
for _report in (RP.outcome_mix, RP.start_zone_map, RP.start_type_shares):
    _on_phases(_report, 6)
_on_phases(RP.outcome_shares, 5)


@on_tables()
def mean_canonical_x(t):
    return RP.mean_canonical_x(t.phase_events)


@on_tables()
def goal_counts(t):
    return RP.goal_counts(t.events)


@on_tables()
def switch_distance_stats(t):
    return RP.switch_distance_stats(t.events)


@on_tables()
def switch_thresholds(t):
    return RP.switch_thresholds(t.events)


@on_tables()
def counter_stats(t):
    return RP.counter_stats(t.chains)


@on_tables()
def speed_sweep(t):
    return RP.speed_sweep(t.chains)


# Profiles of the raw feed ------------------------------------------------------------------------


def _marked(t: Tables) -> DataFrame:
    # The segmented table drops the shoot-out; coverage counts every event of the feed.
    keys = t.frames.select("match_id", "event_uuid", F.lit(True).alias("_f"))
    return t.events.join(by_shuffle(keys), ["match_id", "event_uuid"], "left").withColumn(
        "has_frame", F.col("_f").isNotNull()
    )


@on_tables()
def coverage_by_match(t):
    return PR.coverage_by_match(_marked(t), t.frames)


@on_tables()
def coverage_by_type(t):
    return PR.coverage_by_type(_marked(t))


@on_tables()
def feed_invariants(t):
    return PR.feed_invariants(t.events)


@on_tables()
def chain_borders(t):
    return PR.chain_borders(t.chains)


@on_tables()
def chain_openers(t):
    return PR.chain_openers(t.segmented)


@on_tables()
def field_presence(t):
    return PR.presence(t.events)


@on_tables()
def outcome_domain(t):
    return PR.value_domain(t.events, "outcome_id")


@on_tables()
def mirrored_pairs(t):
    return PR.mirrored_pairs(t.events, within_s=1.7)


@on_tables()
def pressure_overlap(t):
    return PR.pressure_overlap(t.events)


@on_tables()
def pressure_deltas(t):
    return PR.pressure_deltas(t.events)


@on_tables(6)
def counterpress_rates(t):
    return PR.counterpress_rates(t.events)


@on_tables(6)
def pattern_shares(t):
    return PR.pattern_shares(t.events)


@on_tables()
def events_per_match(t):
    return PR.events_per_match(t.events)


@on_tables()
def frame_links(t):
    return PR.frame_links(t.events, t.frames)


@on_tables()
def shot_direction(t):
    return PR.direction_check(t.events, K.SHOT)


@on_tables()
def keeper_direction(t):
    return PR.direction_check(t.events, K.GOALKEEPER)


@on_tables()
def turnover_flavours(t):
    return PR.turnover_flavours(t.chains)


@on_tables(6)
def keeper_sides(t):
    facts = t.segmented.select("match_id", "event_uuid", "x", "y")
    return FR.keeper_sides(FR.frame_scalars(t.frames).join(by_shuffle(facts), ["match_id", "event_uuid"]))


# Quality -----------------------------------------------------------------------------------------


@on_tables()
def quality_checks(t):
    return Q.run_checks(t)


@on_tables()
def quality_manifest(t):
    return Q.manifest_checks(t, RP.stored_manifest(t))


def _replaced(t):
    """A copy of the events after a replacement: 1001 and 1003 shifted by 100 s, 1002 removed, and a
    match that was not there and is not named among the replaced ones (1001 under another id)."""
    spark = t.phases.sparkSession
    path = storage.new_path(spark, "copy")
    snapshots.write(t.phase_events.drop("bucket"), path, "event_index")
    moved = t.phase_events.filter(F.col("match_id").isin(1001, 1003)).withColumn(
        "t_offset_s", (F.col("t_offset_s") + 100).cast("float")
    )
    added = moved.filter("match_id = 1001").withColumn("match_id", F.lit(900_001).cast("long"))
    named = t.matches.select("match_id").filter(F.col("match_id").isin(1001, 1002, 1003))
    return snapshots.replace_matches(spark, path, moved.unionByName(added), named)


@on_tables()
def replaced_match_rows(t):
    """Events per match after two matches of a copied table were replaced by shifted ones."""
    spark = t.phases.sparkSession
    path = storage.new_path(spark, "copy")
    snapshots.write(t.phase_events.drop("bucket"), path, "event_index")
    chosen = t.matches.select("match_id").filter(F.col("match_id").isin(1001, 1003))
    shifted = t.phase_events.join(chosen, "match_id").withColumn(
        "t_offset_s", (F.col("t_offset_s") + 100).cast("float")
    )
    now = snapshots.replace_matches(spark, path, shifted, chosen)
    return now.groupBy("match_id").agg(
        F.count("*").alias("n"), F.max(F.col("t_offset_s").cast("double")).alias("latest")
    )


@on_tables(5)
def refreshed_moments(t):
    """Feature moments after Cup A's matches were published again without their passless phases.

    Follows the replacement from stored moments of each match; the other matches are not read again.
    """
    spark = t.phases.sparkSession
    path = storage.new_path(spark, "match-moments")
    snapshots.write(SIM.match_moments(t.phases), path)
    cup = t.phases.filter(F.col("competition") == "Cup A")
    stats = SIM.refresh_moments(spark, path, cup.filter("n_passes > 0"), cup.select("match_id").distinct())
    return spark.range(1).select(*[
        F.lit(value).alias(f"{part}_{c}") for c, pair in stats.items() for part, value in zip(("mu", "sd"), pair)
    ])


@on_tables()
def replaced_match_events(t):
    """Every event of a table in which matches were replaced, removed and added."""
    return _replaced(t).select(
        "match_id", "phase_id", "idx", "event_uuid", "type_id", F.col("t_offset_s").cast("double").alias("t_offset_s")
    )


@on_tables()
def goal_balance(t):
    return Q.goal_balance(t)


@on_tables()
def score_balance(t):
    return Q.score_balance(t.phases, t.matches)


@on_tables(6)
def restart_plausibility(t):
    return Q.plausibility(t.phases)


@on_tables()
def self_nearest(t):
    return Q.self_nearest(t.similarity)


# Similarity --------------------------------------------------------------------------------------


@on_tables()
def similar_phases(t):
    return SIM.similar_phases(t.similarity, t.phases, TARGET_PHASE).select(
        "phase_id", "score", "team_name", "start_type", "outcome"
    )


def embeddings(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


@on_folder()
def similar_embeddings(spark, sf):
    return SIM.similar_to(embeddings(spark, sf), 0, 48, "vec_id", "embedding", digits=6)


def _embedding_rows(spark, sf):
    return embeddings(spark, sf).select(
        F.col("vec_id").alias("id"), F.lit("all").alias("split"), F.col("embedding").alias("vec")
    )


@on_folder()
def nearest_embeddings(spark, sf):
    """25 nearest others of every vector."""
    return E.nearest_neighbours(_embedding_rows(spark, sf)).select("id", "place", "neighbour")


def _embedding_labels(spark, sf):
    rows = embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").alias("own"))
    # One array with every label that occurs; a class list, not rows.
    found = rows.agg(F.array_sort(F.collect_set("own")).alias("labels"))
    return rows.join(F.broadcast(found)).select("id", "own", F.explode("labels").alias("label")).select(
        "id", F.col("label").cast("string").alias("label"),
        (F.col("own") == F.col("label")).cast("double").alias("value"),
    )


@on_folder(6)
def embedding_label_auc(spark, sf):
    """One-against-rest AUC of the neighbour vote."""
    near = E.nearest_neighbours(_embedding_rows(spark, sf))
    return E.label_probe(near, _embedding_labels(spark, sf))


# Evaluation --------------------------------------------------------------------------------------


@on_tables(5)
def event_features(t):
    return E.event_features(t.phase_events)


@on_tables()
def training_phases(t):
    return E.training_phases(t.phases).select("phase_id", "n_events")


@on_tables()
def thinned_phases(t):
    """Events kept when windows hold eight."""
    rows = t.phase_events.select("phase_id", "idx", "type_id")
    return E.thin_long_phases(rows, t.phases.select("phase_id", "n_events"), 8)


@on_tables(5)
def padded_windows(t):
    """Padded windows of eight events, one row per slot."""
    windows = E.padded_windows(
        E.event_features(t.phase_events), t.phases.select("phase_id", "n_events"), 8
    )
    slots = F.arrays_zip(
        F.col("types").alias("types"), F.col("mask").alias("mask"), F.col("numeric").alias("numeric")
    )
    return windows.select("phase_id", "length", F.posexplode(slots).alias("slot", "s")).select(
        "phase_id", "length", "slot", F.col("s.types").alias("type_idx"),
        F.col("s.mask").alias("mask"),
        *[F.col("s.numeric")[i].alias(c) for i, c in enumerate(K.EVENT_CHANNELS)],
    )


@on_tables()
def half_sizes(t):
    """Events per half of the phases eligible for split-half retrieval."""
    return (
        E.split_halves(t.phase_events, t.phases)
        .groupBy("phase_id", "half")
        .agg(F.count("*").alias("n"))
    )


@on_tables()
def half_features(t):
    return E.slice_features(
        E.split_halves(t.phase_events, t.phases), ["phase_id", "half"]
    ).drop("path_xy")


def _halves(t: Tables, mode: str):
    vectors = written_once(
        t,
        f"half_vectors_{mode}",
        lambda: E.half_vectors(t.phase_events, t.phases, SIM.fit_moments(t.phases), mode),
    ).select(F.col("phase_id").alias("id"), F.lit("all").alias("split"), "half", "vec")
    first = vectors.filter("half = 1").drop("half")
    return first, vectors.filter("half = 2").drop("half")


@on_tables()
def half_ranks_generous(t):
    return E.rank_of_gold(*_halves(t, "generous"))


@on_tables()
def half_ranks_strict(t):
    return E.rank_of_gold(*_halves(t, "strict"))


@on_tables(6)
def retrieval_metrics(t):
    # One mode after the other, its ranks and its row written: as one plan both would be ranked twice.
    spark, out = t.phases.sparkSession, None
    for mode in ("generous", "strict"):
        ranks = storage.save(E.rank_of_gold(*_halves(t, mode)), storage.new_path(spark, "half-ranks"))
        row = E.retrieval_metrics(ranks).select(
            F.lit(mode).alias("mode"), "n", "mrr", "recall_1", "recall_10", "median_rank"
        )
        one = storage.save(row, storage.new_path(spark, "metrics"))
        out = one if out is None else out.unionByName(one)
    return out


@on_tables()
def reproduction_summary(t):
    """Stored against rebuilt vectors of whole phases."""
    stats = SIM.fit_moments(t.phases)
    return E.reproduction_summary(
        E.check_reproduction(t.phase_events, t.phases, t.similarity, stats)
    )


@on_tables()
def probe_labels(t):
    return E.label_matrix(E.phase_labels(t.segmented), t.phases)


@on_tables(6)
def label_prevalence(t):
    return E.prevalence(E.unpivot_labels(E.label_matrix(E.phase_labels(t.segmented), t.phases)))


def _probe(t: Tables) -> DataFrame:
    labels = E.unpivot_labels(E.label_matrix(E.phase_labels(t.segmented), t.phases))
    rows = t.similarity.select(F.col("phase_id").alias("id"), F.lit("all").alias("split"), "vec")
    near = written_once(t, "neighbours", lambda: E.nearest_neighbours(rows))
    return E.label_probe(near, labels)


@on_tables()
def phase_label_auc(t):
    return _probe(t)


@on_tables()
def ship_decision(t):
    """Strict against generous half vectors under the three-condition rule."""
    # Ranks, their metrics and the probe (one for both rows) are written: as one plan each would be made twice.
    spark = t.phases.sparkSession
    macro = storage.save(E.macro_auc(_probe(t)).select("macro_auc"), storage.new_path(spark, "macro-auc"))

    def row(mode: str) -> DataFrame:
        ranks = storage.save(E.rank_of_gold(*_halves(t, mode)), storage.new_path(spark, "half-ranks"))
        metrics = storage.save(E.retrieval_metrics(ranks), storage.new_path(spark, "metrics"))
        return metrics.join(F.broadcast(macro), F.lit(True))

    return E.ship_decision(row("generous"), row("strict"))


# Augmentation ------------------------------------------------------------------------------------


def _lean(t: Tables) -> DataFrame:
    return t.phase_events.select(
        "phase_id", "idx", "t_offset_s", "type_id", "team_side", "x", "y", "end_x", "end_y"
    )


@on_tables()
def cropped_events(t):
    return AUG.crop(_lean(t), SEED).select("phase_id", "idx", "type_id")


@on_tables()
def thinned_events(t):
    return AUG.drop_events(_lean(t), SEED, 0.4).select("phase_id", "idx", "type_id")


@on_tables()
def jittered_events(t):
    return AUG.jitter_locations(_lean(t), SEED).select("phase_id", "idx", "x", "y", "end_x", "end_y")


@on_tables()
def stretched_events(t):
    return AUG.stretch_tempo(_lean(t), SEED).select("phase_id", "idx", "t_offset_s")


@on_tables()
def augmented_events(t):
    return AUG.augment(_lean(t), SEED).select("phase_id", "idx", "t_offset_s", "x", "y", "end_x", "end_y")


# Replay ------------------------------------------------------------------------------------------


def _keyframes(t: Tables) -> DataFrame:
    return written_once(t, "keyframes", lambda: R.ball_keyframes(t.phase_events))


@on_tables()
def ball_keyframes(t):
    return _keyframes(t)


@on_tables()
def ball_positions(t):
    return R.ball_positions(_keyframes(t), t.phases, 0.5)


@on_tables()
def current_frames(t):
    return R.current_frames(R.timed_frames(t.phase_events, t.phase_frames), t.phases, 0.5)


@on_tables()
def ball_trail(t):
    """Key-frames passed by the middle of every phase."""
    times = t.phases.select("phase_id", (F.col("duration_s").cast("double") / 2).alias("at"))
    return R.trail(_keyframes(t), times)


@on_tables()
def timeline_markers(t):
    return R.markers(t.phase_events).select("phase_id", "idx", "type_name", "t_offset_s")


def queries() -> dict[str, Query]:
    return dict(QUERIES)
