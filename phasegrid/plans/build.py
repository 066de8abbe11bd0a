"""Flat events, frames and matches -> the published tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import geometry as G
from phasegrid.functions.scan import block_of, by_shuffle, join_fragments
from phasegrid.operators import features, frames as FR, path as P, similar
from phasegrid.operators.segment import CHAIN, segment
from phasegrid.plans import reports
from phasegrid.sources import snapshots, storage, testdata

# Small source integers are widened so that an oversize match cannot overflow a column.
PHASE_COLUMNS = {
    "phase_id": "string", "match_id": "bigint", "seq": "bigint", "competition": "string",
    "match_label": "string", "team_id": "bigint", "team_name": "string", "opponent_id": "bigint",
    "opponent_name": "string", "period": "int", "possession": "int", "minute": "int",
    "second": "int", "start_ts": "float", "end_ts": "float", "abs_start_s": "float",
    "duration_s": "float", "n_events": "bigint", "n_passes": "bigint", "n_players": "bigint",
    "n_shots": "bigint", "start_zone": "string", "end_zone": "string", "start_x": "float",
    "start_y": "float", "end_x": "float", "end_y": "float", "max_x": "float",
    "start_type": "string", "outcome": "string", "progression_m": "float",
    "direct_speed_m_s": "float", "pressure_events": "bigint", "high_press_regain": "boolean",
    "counterattack": "boolean", "switch_of_play": "boolean", "reached_final_third": "boolean",
    "reached_box": "boolean", "xg": "float", "goal_conceded": "boolean", "has_360": "boolean",
    "frame_coverage": "float", "path_xy": "array<float>",
}
EVENT_COLUMNS = {
    "phase_id": "string", "idx": "bigint", "event_uuid": "string", "event_index": "bigint",
    "t_offset_s": "float", "type_id": "int", "type_name": "string", "player_name": "string",
    "position_name": "string", "team_side": "string", "team_name": "string", "x": "float",
    "y": "float", "end_x": "float", "end_y": "float", "end_z": "float", "outcome_name": "string",
    "under_pressure": "boolean", "counterpress": "boolean", "out": "boolean", "xg": "float",
    "has_frame": "boolean",
}
FRAME_COLUMNS = {
    "phase_id": "string", "idx": "bigint", "event_uuid": "string", "orientation": "string",
    "n_players": "int", "px": "array<float>", "py": "array<float>", "flags": "array<smallint>",
    "visible_area": "array<float>",
}

# What the published tables need of a flat event; anything else stays behind before the shuffles.
EVENT_INPUT = (
    "match_id", "index", "event_uuid", "period", "possession", "possession_team_id", "team_id",
    "team_name", "ts_s", "minute", "second", "duration", "type_id", "type_name",
    "play_pattern_id", "player_id", "player_name", "position_name", "x", "y", "end_x", "end_y",
    "end_z", "outcome_id", "outcome_name", "sub_type_id", "xg", "under_pressure", "counterpress",
    "is_out", "pass_switch", "recovery_failure", "save_block", *K.PROBE_LABELS,
)


def declared(df: DataFrame, columns: dict[str, str], *more: str) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()], *more)


@dataclass(frozen=True)
class Tables:
    """The raw inputs, the segmented events and the published tables of one build at ``path``."""

    events: DataFrame
    frames: DataFrame
    matches: DataFrame
    segmented: DataFrame
    chains: DataFrame
    phases: DataFrame
    phase_events: DataFrame
    phase_frames: DataFrame
    similarity: DataFrame
    path: str


def mark_frames(events: DataFrame, frames: DataFrame) -> DataFrame:
    """``has_frame`` by event uuid."""
    keys = frames.select("match_id", "event_uuid").distinct().withColumn("_f", F.lit(True))
    return (
        events.join(by_shuffle(keys), ["match_id", "event_uuid"], "left")
        .withColumn("has_frame", F.col("_f").isNotNull())
        .drop("_f")
    )


def add_match_facts(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Team, opponent, competition and label from the match table."""
    dim = matches.select(
        "match_id", "competition", F.col("label").alias("match_label"), "home_team_id",
        "home_team_name", "away_team_id", "away_team_name",
    )
    home = F.col("team_id") == F.col("home_team_id")
    return rows.join(dim, "match_id", "left").withColumns(
        {
            "team_name": F.when(home, F.col("home_team_name")).when(
                F.col("team_id") == F.col("away_team_id"), F.col("away_team_name")
            ),
            "opponent_id": F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")),
            "opponent_name": F.when(home, F.col("away_team_name")).otherwise(
                F.col("home_team_name")
            ),
        }
    )


def phase_table(
    chains: DataFrame, seg: DataFrame, matches: DataFrame
) -> DataFrame:
    """Chains with their resampled path and match facts.

    A chain without path points starts and ends at the centre spot, so its path repeats it.
    """
    ours = F.col("team_id") == F.col("chain_team_id")
    ends = chains.select(
        *CHAIN,
        F.col("start_x").alias("sx"),
        F.col("start_y").alias("sy"),
        F.col("end_x").alias("ex"),
        F.col("end_y").alias("ey"),
    )
    paths = P.resample(P.path_points(seg, CHAIN, ours), CHAIN, ends=ends)
    return add_match_facts(chains.join(by_shuffle(paths), CHAIN), matches)


def name_events(seg: DataFrame, chains: DataFrame) -> DataFrame:
    """Segmented events of surviving chains with their ``phase_id``."""
    facts = chains.select(*CHAIN, "phase_id", F.col("n_events").alias("_size"))
    rows = seg.withColumn("_b", block_of(F.col("idx")))
    return join_fragments(rows, facts, CHAIN, "_b", "_size").drop("_b", "_size")


def phase_event_rows(named: DataFrame) -> DataFrame:
    flip = F.col("team_id") != F.col("chain_team_id")
    return named.select(
        "match_id",
        "phase_id",
        "idx",
        "event_uuid",
        F.col("index").alias("event_index"),
        (F.col("ts_s") - F.col("chain_start_ts")).alias("t_offset_s"),
        "type_id",
        "type_name",
        "player_name",
        "position_name",
        F.when(flip, "opponent").otherwise("in_possession").alias("team_side"),
        "team_name",
        G.canonical_x(F.col("x"), flip).alias("x"),
        G.canonical_y(F.col("y"), flip).alias("y"),
        G.canonical_x(F.col("end_x"), flip).alias("end_x"),
        G.canonical_y(F.col("end_y"), flip).alias("end_y"),
        "end_z",
        "outcome_name",
        "under_pressure",
        "counterpress",
        F.col("is_out").alias("out"),
        "xg",
        "has_frame",
    )


def frame_events(named: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames joined to the facts of their events."""
    facts = named.select(
        "match_id", "event_uuid", "phase_id", "idx", F.col("index").alias("event_index"), "x", "y",
        "team_id", "chain_team_id",
    )
    return FR.frame_scalars(frames).join(by_shuffle(facts), ["match_id", "event_uuid"])


def by_match(df: DataFrame, order: str) -> DataFrame:
    """Rows of a match together and in order, a huge match over several tasks.

    A plain hash exchange: unlike a range exchange it needs no sampling pass over the input.
    """
    return (
        df.repartition("match_id", block_of(F.col(order)))
        .sortWithinPartitions("match_id", order)
    )


def in_parallel(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run independent writes at the same time, so that no core waits for another's last task."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def build(
    events: DataFrame,
    frames: DataFrame,
    matches: DataFrame,
    out: str,
    thr: K.Thresholds = K.Thresholds(),
) -> Tables:
    """Build and write every table under ``out``."""
    matches, seg = in_parallel(
        lambda: storage.save(matches, f"{out}/matches"),
        lambda: storage.save(
            segment(mark_frames(events.select(*EVENT_INPUT), frames)),
            f"{out}/segmented",
        ),
    )
    rows = features.build_features(features.aggregate_chains(seg, thr), seg, thr)
    chains = storage.save(
        rows.withColumn("phase_id", G.phase_id(F.col("match_id"), F.col("seq"))), f"{out}/chains"
    )

    size = seg.count()  # of events; frames are no more

    def write_phases() -> DataFrame:
        rows = declared(phase_table(chains, seg, matches), PHASE_COLUMNS, "start_index")
        return storage.save(by_match(rows, "seq"), f"{out}/phases")

    def write_events() -> DataFrame:
        named = name_events(seg, chains)
        rows = declared(phase_event_rows(named), EVENT_COLUMNS, "match_id")
        return snapshots.write(rows, f"{out}/phase_events", "event_index", size)

    def write_frames() -> DataFrame:
        named = name_events(seg, chains)
        framed = FR.canonicalize(frame_events(named, frames))
        rows = declared(framed, FRAME_COLUMNS, "match_id", "event_index")
        kept = [*FRAME_COLUMNS, "match_id"]
        return snapshots.write(rows, f"{out}/phase_frames", "event_index", size, kept)

    phases, phase_events, phase_frames = in_parallel(write_phases, write_events, write_frames)
    vectors = storage.save(
        similar.phase_vectors(phases, similar.fit_moments(phases), "phase_id"), f"{out}/similarity"
    )
    tables = Tables(
        events, frames, matches, seg, chains, phases, phase_events, phase_frames, vectors, out
    )
    storage.save(reports.manifest(tables), f"{out}/manifest")
    return tables


_BUILT: dict[tuple[str, str], Tables] = {}


def remember(spark: SparkSession, sf_dir: str, tables: Tables) -> None:
    """Let queries over ``sf_dir`` read an existing build."""
    _BUILT[(spark.sparkContext.applicationId, sf_dir)] = tables


def testdata_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables built from the match-event view of one data folder, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        out = storage.new_path(spark, "tables")
        source = spark.read.parquet(f"{sf_dir}/events.parquet")
        ordered = testdata.range_blocks(spark, source, f"{out}/ordered")
        flat = storage.save(testdata.flat_events(spark, ordered), f"{out}/events")
        frames = storage.save(testdata.flat_frames(flat), f"{out}/frames")
        remember(spark, sf_dir, build(flat, frames, testdata.match_dimension(flat), out))
    return _BUILT[key]
