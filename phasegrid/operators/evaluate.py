"""Event features, half-phase vectors, retrieval ranks and the label probe."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import geometry as G
from phasegrid.functions import vectors as V
from phasegrid.functions.scan import block_of, by_shuffle, join_fragments, ordered_scan
from phasegrid.operators import path as P
from phasegrid.operators.quantile import auc, quantiles
from phasegrid.operators.similar import phase_vectors
from phasegrid.sources import storage

MIN_TRAIN_EVENTS = 4
MIN_EVENTS, MIN_HALF_PATH = 8, 2
SPEED_FLOOR_S = 0.05
PAIR_BLOCK_ROWS = 4096
# Vectors that others gather around for all-pairs work: so many at most come to the driver.
PIVOTS = 1024
# Groups of query blocks that candidates are moved to, and the bytes of one (as doubles).
GROUPS = 24
GROUP_BYTES = 64 << 20
MAX_TASKS = 4096
# Rows of a query block, and of a candidate block, that are multiplied at once.
SLICE_ROWS, PIECE_ROWS = 512, 2048
# Products worked out again in double precision at once; above the share (a power of 2) all are.
EXACT_ROWS, EXACT_SHARE = 16384, 4
SIM_DIGITS = 6


def ours() -> Column:
    return F.col("team_side") == "in_possession"


def training_phases(phases: DataFrame) -> DataFrame:
    return phases.filter(F.col("n_events") >= MIN_TRAIN_EVENTS)


# Event features ------------------------------------------------------------------------------


def type_index(type_id: Column) -> Column:
    """1-based place in the event-type vocabulary, 0 for an unknown type."""
    return G.lookup(
        type_id, {t: i + 1 for i, t in enumerate(K.TYPE_VOCABULARY)}, F.lit(0)
    )


def event_features(events: DataFrame, key: Sequence[str] = ("phase_id",)) -> DataFrame:
    """15 scaled channels per event; time is relative to the first event of ``key``."""
    keys = list(key)
    rows = events.select(
        *keys,
        "idx",
        type_index(F.col("type_id")).alias("type_idx"),
        F.col("t_offset_s").cast("double").alias("t"),
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "end_x", "end_y", "xg")],
        *[F.col(c).cast("double").alias(c) for c in ("under_pressure", "counterpress", "out")],
        ours().cast("double").alias("side"),
    )
    first = rows.groupBy(*keys).agg(
        F.min_by("t", "idx").alias("_t0"), (F.max("idx") + 1).alias("_size")
    )
    rows = join_fragments(rows.withColumn("_b", block_of(F.col("idx"))), first, keys, "_b", "_size")
    timed = ordered_scan(rows, keys, "idx", lag={"_before": F.col("t")}, block="_b")
    has_loc, has_end = F.col("x").isNotNull(), F.col("end_x").isNotNull()
    gap = F.coalesce(F.col("t") - F.col("_before"), F.lit(0.0))

    def clip(v: Column, lo: float, hi: float) -> Column:
        return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))

    def present(cond: Column, v: Column) -> Column:
        return F.when(cond, v).otherwise(F.lit(0.0))

    return timed.select(
        *keys,
        "idx",
        "type_idx",
        present(has_loc, F.col("x") / 60.0 - 1.0).alias("x"),
        present(has_loc, F.col("y") / 40.0 - 1.0).alias("y"),
        has_loc.cast("double").alias("has_loc"),
        present(has_end, F.col("end_x") / 60.0 - 1.0).alias("end_x"),
        present(has_end, F.col("end_y") / 40.0 - 1.0).alias("end_y"),
        has_end.cast("double").alias("has_end"),
        present(has_loc & has_end, (F.col("end_x") - F.col("x")) / 30.0).alias("dx"),
        present(has_loc & has_end, (F.col("end_y") - F.col("y")) / 20.0).alias("dy"),
        clip((F.col("t") - F.col("_t0")) / 30.0, 0.0, 4.0).alias("t_rel"),
        clip(F.log1p(F.greatest(gap, F.lit(0.0))) / 2.0, 0.0, 2.0).alias("dt"),
        "under_pressure",
        "counterpress",
        "out",
        clip(F.coalesce("xg", F.lit(0.0)), 0.0, 1.0).alias("xg"),
        "side",
    )


def thin_long_phases(features: DataFrame, sizes: DataFrame, max_len: int = 64) -> DataFrame:
    """Uniform stride over phases longer than ``max_len``; both ends stay."""
    rows = join_fragments(
        features.withColumn("_b", block_of(F.col("idx"))), sizes, ["phase_id"], "_b", "n_events"
    )
    return rows.filter(P.stride_keep(F.col("idx"), F.col("n_events"), max_len)).select(
        *features.columns
    )


def padded_windows(features: DataFrame, sizes: DataFrame, max_len: int = 64) -> DataFrame:
    """One row per phase: channels and types right-padded to ``max_len``, with a mask.

    At most ``max_len`` events per phase survive the stride, so the arrays are bounded.
    """
    kept = thin_long_phases(features, sizes, max_len)
    channels = F.array(*[F.col(c) for c in K.EVENT_CHANNELS])
    packed = kept.groupBy("phase_id").agg(
        F.array_sort(
            F.collect_list(F.struct("idx", channels.alias("numeric"), F.col("type_idx")))
        ).alias("rows")
    )
    pad = F.lit(max_len) - F.size("rows")
    blank = F.array_repeat(F.lit(0.0), len(K.EVENT_CHANNELS))
    return packed.select(
        "phase_id",
        F.size("rows").alias("length"),
        F.concat(F.col("rows.numeric"), F.array_repeat(blank, pad)).alias("numeric"),
        F.concat(F.col("rows.type_idx"), F.array_repeat(F.lit(0), pad)).alias("types"),
        F.concat(
            F.transform("rows", lambda r: F.lit(True)), F.array_repeat(F.lit(False), pad)
        ).alias("mask"),
    )


# Slices of a phase ---------------------------------------------------------------------------


def split_halves(events: DataFrame, phases: DataFrame) -> DataFrame:
    """Events of eligible phases with ``half`` 1 or 2, cut at ceil(n/2) events.

    Eligible: at least 8 events, and at least 2 path events in each half.
    """
    sizes = phases.filter(F.col("n_events") >= MIN_EVENTS).select("phase_id", "n_events")
    rows = events.withColumn("_b", block_of(F.col("idx")))
    rows = join_fragments(rows, sizes, ["phase_id"], "_b", "n_events")
    halved = rows.withColumn(
        "half", F.when(F.col("idx") < F.ceil(F.col("n_events") / 2), 1).otherwise(2)
    )
    on_path = P.on_path(ours())
    eligible = (
        halved.groupBy("phase_id")
        .agg(
            F.count_if(on_path & (F.col("half") == 1)).alias("a"),
            F.count_if(on_path & (F.col("half") == 2)).alias("b"),
        )
        .filter((F.col("a") >= MIN_HALF_PATH) & (F.col("b") >= MIN_HALF_PATH))
        .join(by_shuffle(sizes), "phase_id")
    )
    kept = join_fragments(
        halved.drop("n_events"), eligible.select("phase_id", "n_events"), ["phase_id"], "_b", "n_events"
    )
    return kept.select(*events.columns, "half")


def slice_features(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Phase features recomputed from the event rows of any slice; slices without path drop out."""
    keys = list(key)
    d = rows.withColumns(
        {c: F.col(c).cast("double") for c in ("x", "y", "end_x", "end_y", "t_offset_s", "xg")}
    )
    mine, t = ours(), F.col("type_id")
    ball = ~G.is_admin(t)
    at_path = F.when(P.on_path(mine), F.col("idx"))
    end_x, end_y = F.coalesce("end_x", "x"), F.coalesce("end_y", "y")
    clock = F.when(ball, F.col("t_offset_s"))
    boxed = G.in_box(F.col("x"), F.col("y")) | F.coalesce(
        G.in_box(F.col("end_x"), F.col("end_y")), F.lit(False)
    )
    facts = d.groupBy(*keys).agg(
        F.coalesce(F.max(clock) - F.min(clock), F.lit(0.0)).alias("duration_s"),
        F.count_if(mine & (t == K.PASS)).alias("n_passes"),
        F.count("*").alias("n_events"),
        F.count_if(~mine & (t == K.PRESSURE)).alias("pressure_events"),
        F.coalesce(
            F.max(F.when(mine & (t == K.SHOT), F.coalesce("xg", F.lit(0.0)))), F.lit(0.0)
        ).alias("xg"),
        F.min_by("x", at_path).alias("start_x"),
        F.min_by("y", at_path).alias("start_y"),
        F.max_by(end_x, at_path).alias("end_x"),
        F.max_by(end_y, at_path).alias("end_y"),
        F.max(F.when(at_path.isNotNull(), F.greatest("x", "end_x"))).alias("max_x"),
        F.coalesce(F.bool_or(at_path.isNotNull() & boxed), F.lit(False)).alias("reached_box"),
        F.coalesce(
            F.bool_or(
                mine
                & (t == K.PASS)
                & F.coalesce(F.abs(F.col("end_y") - F.col("y")) >= 40.0, F.lit(False))
            ),
            F.lit(False),
        ).alias("switch_of_play"),
    )
    players = (
        d.filter(mine & (F.coalesce("player_name", F.lit("")) != ""))
        .select(*keys, "player_name")
        .distinct()
        .groupBy(*keys)
        .agg(F.count("*").alias("n_players"))
    )
    ends = facts.filter(F.col("start_x").isNotNull()).select(
        *keys,
        F.col("start_x").alias("sx"),
        F.col("start_y").alias("sy"),
        F.col("end_x").alias("ex"),
        F.col("end_y").alias("ey"),
    )
    paths = P.resample(P.path_points(d, keys, mine), keys, ends=ends)
    progression = (F.col("end_x") - F.col("start_x")) * K.YARD_M
    return (
        facts.join(by_shuffle(paths), keys)
        .join(by_shuffle(players), keys, "left")
        .withColumns(
            {
                "n_players": F.coalesce("n_players", F.lit(0).cast("long")),
                "progression_m": progression,
                "direct_speed_m_s": F.when(
                    F.col("duration_s") >= SPEED_FLOOR_S, progression / F.col("duration_s")
                ).otherwise(F.lit(0.0)),
                "reached_final_third": F.col("max_x") >= K.FINAL_THIRD_X,
                "start_zone": G.zone(F.col("start_x"), F.col("start_y")),
                "end_zone": G.zone(F.col("end_x"), F.col("end_y")),
            }
        )
    )


def inherit_labels(slices: DataFrame, phases: DataFrame, mode: str = "generous") -> DataFrame:
    """Labels a slice cannot own: from the parent phase (``generous``) or withheld (``strict``)."""
    if mode == "strict":
        nothing = F.lit(None).cast("string")
        return slices.withColumns(
            {
                "start_type": nothing,
                "outcome": nothing,
                "high_press_regain": F.lit(False),
                "counterattack": F.lit(False),
            }
        )
    if mode != "generous":
        raise ValueError(f"unknown mode {mode!r}")
    parent = phases.select(
        "phase_id", "start_type", "outcome", "high_press_regain", "counterattack"
    )
    return slices.join(by_shuffle(parent), "phase_id")


def half_vectors(events: DataFrame, phases: DataFrame, stats: dict, mode: str = "generous") -> DataFrame:
    """(phase_id, half, vec) of eligible phases.

    The halves feed several aggregates and the path scan, so they are written once.
    """
    spark = events.sparkSession
    rows = storage.save(split_halves(events, phases), storage.new_path(spark, "halves"))
    halves = slice_features(rows, ["phase_id", "half"])
    return phase_vectors(inherit_labels(halves, phases, mode), stats, "phase_id", "half")


def check_reproduction(events: DataFrame, phases: DataFrame, similarity: DataFrame, stats: dict) -> DataFrame:
    """Cosine between stored vectors and vectors rebuilt from the event rows of whole phases."""
    rebuilt = phase_vectors(
        inherit_labels(slice_features(events, ["phase_id"]), phases), stats, "phase_id"
    ).withColumnRenamed("vec", "mine")
    norm = F.sqrt(V.dot(F.col("vec"), F.col("vec")) * V.dot(F.col("mine"), F.col("mine")))
    return rebuilt.join(by_shuffle(similarity), "phase_id").select(
        "phase_id", (V.dot(F.col("vec"), F.col("mine")) / norm).alias("cosine")
    )


def reproduction_summary(cosines: DataFrame) -> DataFrame:
    p05 = quantiles(cosines, "cosine", {"cosine_p05": 0.05})
    facts = cosines.agg(
        F.avg("cosine").alias("cosine_mean"),
        F.min("cosine").alias("cosine_min"),
        F.min_by("phase_id", F.struct(F.round("cosine", SIM_DIGITS), "phase_id")).alias("worst_phase"),
    )
    return p05.join(F.broadcast(facts), F.lit(True))


# All-pairs work in bounded blocks ------------------------------------------------------------


def _low_hashes(vectors: DataFrame, share: float) -> DataFrame:
    """The vectors in the lowest share of the id hashes."""
    edge = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
    return vectors.filter(F.xxhash64("id") <= F.lit(edge))


def _sample(vectors: DataFrame, rows: int) -> DataFrame:
    """So many vectors, by id hash."""
    return vectors.select("vec").orderBy(F.xxhash64("id"), F.xxhash64("vec")).limit(rows)


def _pivots(vectors: DataFrame, rows_per_block: int) -> np.ndarray | None:
    """Rows that the others gather around: two for each block's worth, PIVOTS at most; None where
    everything fits into one block.

    Of a sample of eight times as many rows (by id hash), each next one is the farthest from those
    chosen before it, so small clusters get theirs too.
    """
    n = vectors.count()
    if n <= rows_per_block:
        return None
    count = min(2 * -(-n // rows_per_block), PIVOTS)
    # Every task of a sort with a limit sends the driver as many rows as the limit, so that only a
    # share of the rows goes there, by hash, in which all of the sample is to be expected.
    rows = _sample(_low_hashes(vectors, 16 * count / n), 8 * count).toPandas()
    if len(rows) < 8 * count:  # ids that repeat
        rows = _sample(vectors, 8 * count).toPandas()
    sample = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    far, chosen = np.full(len(sample), np.inf), []
    for _ in range(min(count, len(sample))):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
    return sample[chosen]


def _in_cells(vectors: DataFrame, pivots: np.ndarray, rows_per_block: int) -> DataFrame:
    """Rows with the ``cell`` of their nearest pivot, cell by cell in tasks of a few blocks each."""
    spark = vectors.sparkSession
    schema = ", ".join(f"`{c}` {k}" for c, k in vectors.dtypes) + ", cell int"
    half = (pivots**2).sum(axis=1) / 2

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.iloc[lo : lo + 2048]
                matrix = np.stack(part["vec"].to_numpy()).astype(np.float64)
                yield part.assign(cell=(matrix @ pivots.T - half).argmax(axis=1).astype(np.int32))

    placed = storage.save(vectors.mapInPandas(assign, schema), storage.new_path(spark, "cells"))
    sizes = placed.groupBy("split", "cell").count()
    # A popular cell is dealt over as many tasks as it has pairs of blocks.
    parts = F.ceil(F.col("count") / (2 * rows_per_block))
    salted = placed.join(sizes, ["split", "cell"]).withColumn("_salt", F.pmod(F.xxhash64("id"), parts))
    return salted.repartition("split", "cell", "_salt").sortWithinPartitions("split", "cell").drop("count", "_salt")


def _packed(vectors: DataFrame, rows_per_block: int, *facts: str, pivots: np.ndarray | None = None) -> DataFrame:
    """About ``rows_per_block`` vectors of one split and cell in a row: ids, facts and one packed
    matrix, with the block's centre, its radius, and the largest norm of a row.

    The written table has one row a block and numbers the blocks of each split from 1.  Without
    pivots vectors are packed where they lie, so nothing is shuffled.
    """
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    lists = ["id", *facts]
    form = _kind(vectors)
    columns = vectors.select("split", *lists, "vec")
    columns = columns.withColumn("cell", F.lit(0)) if pivots is None else _in_cells(columns, pivots, rows_per_block)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flushed(key) -> pd.DataFrame:
            rows = pd.concat(held.pop(key))
            matrix = np.stack(rows["vec"].to_numpy()).astype(form)
            wide = matrix.astype(np.float64)
            centre = wide.mean(axis=0)
            columns = {c: [rows[c].tolist()] for c in lists}
            return pd.DataFrame({
                "split": [key[0]], **columns, "matrix": [matrix.tobytes()], "centre": [centre],
                "radius": [float(np.linalg.norm(wide - centre, axis=1).max())],
                "norm": [float(np.linalg.norm(wide, axis=1).max())], "rows": [len(rows)],
            })

        for batch in batches:
            for key, rows in batch.groupby(["split", "cell"], sort=False):
                for lo in range(0, len(rows), rows_per_block):
                    held.setdefault(key, []).append(rows.iloc[lo : lo + rows_per_block])
                    if sum(map(len, held[key])) >= rows_per_block:
                        yield flushed(key)
            if sum(len(r) for parts in held.values() for r in parts) >= 4 * rows_per_block:
                yield from [flushed(key) for key in list(held)]
        yield from [flushed(key) for key in list(held)]

    arrays = ", ".join(f"{c} array<{kinds[c]}>" for c in lists)
    blocks = columns.mapInPandas(
        pack, f"split {kinds['split']}, {arrays}, matrix binary, centre array<double>, radius double, norm double, rows long"
    )
    order = Window.partitionBy("split").orderBy("first")
    named = storage.save(
        blocks.withColumn("first", F.xxhash64("id")), storage.new_path(spark, "vector-blocks")
    )
    numbers = named.select("split", "first").withColumn("block", F.row_number().over(order))
    return named.join(numbers, ["split", "first"]).drop("first")


def _outline(packed: DataFrame, *more: Column) -> DataFrame:
    return packed.select("split", "block", "centre", "radius", "norm", "rows", *more)


def _bounded_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every pair of a query block's and a candidate block's outline of a split, with bounds of all
    similarities (dot products) of their rows; no matrix is moved.

    ``upper``: the lesser of what the distance of the centres, less both radii, leaves of a product
    (triangle inequality), and the centres' product plus what the radii can add; ``lower``: the
    centres' product less that.  Both leave room for rounding.
    """
    totals = candidates.groupBy("split").agg(F.max("block").alias("n"))
    mine = queries.join(totals, "split").withColumn("other", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    theirs = candidates.select("split", F.col("block").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("centre", "radius", "norm", "rows")])
    both = mine.join(theirs, ["split", "other"])
    size = lambda c: F.sqrt(V.dot(F.col(c), F.col(c)))
    centres = V.dot(F.col("centre"), F.col("o_centre"))
    reach = size("centre") * F.col("o_radius") + size("o_centre") * F.col("radius") + F.col("radius") * F.col("o_radius")
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "o_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    gap = F.greatest(apart - F.col("radius") - F.col("o_radius"), F.lit(0.0))
    distant = (F.col("norm") ** 2 + F.col("o_norm") ** 2 - gap**2) / 2
    room = F.lit(2e-6) + (F.col("norm") * F.col("o_norm")) * 1e-9
    return both.select(
        *queries.columns, "other", "o_rows", (F.least(distant, centres + reach) + room).alias("upper"), (centres - reach - room).alias("lower")
    )


def _blocks_per_group(queries: DataFrame, held: int = 0) -> tuple[int, int]:
    """Query blocks that share a task, and how many groups that makes: GROUPS groups in all, of
    GROUP_BYTES at most, with ``held`` numbers for each row besides its vector."""
    size = F.col("rows") * (F.size("centre") + held) * 8
    last, most = queries.agg(F.max("block"), F.max(size)).first()
    per = max(1, min(-(-(last or 1) // GROUPS), GROUP_BYTES // max(most or 1, 1)))
    return per, -(-(last or 1) // per)


def _dealt(spark: SparkSession, parts: int) -> list[int]:
    """Numbers that a hash exchange of so many partitions deals out evenly, one to each."""
    found: dict[int, int] = {}
    numbers = spark.range(32 * parts).select(F.col("id").cast("int").alias("i"))
    for i, part in numbers.select("i", F.pmod(F.hash("i"), F.lit(parts))).collect():
        found.setdefault(part, i)
    return [found.get(part, part) for part in range(parts)]


def _side_by_side(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, *facts: str, held: int = 0) -> DataFrame:
    """The blocks of chosen pairs (split, block, other), dealt to tasks for ``_meetings``.

    Query blocks gather in groups.  A candidate block is moved once for each group, with the
    ``wanted`` blocks of the group, and not once for each pair; so what is moved grows with the rows
    as long as GROUPS groups hold them.
    """
    per, groups = _blocks_per_group(queries, held)
    parts = min(groups, MAX_TASKS)
    numbers = F.array(*map(F.lit, _dealt(queries.sparkSession, parts)))
    group = F.floor((F.col("block") - 1) / per).alias("group")
    chosen = pairs.groupBy("split", group, F.col("other").alias("block")).agg(F.collect_set(F.col("block").cast("long")).alias("wanted"))
    columns = ["split", "group", "block", "id", "matrix", *facts, "wanted"]
    asked = queries.join(by_shuffle(pairs.select("split", "block").distinct()), ["split", "block"], "left_semi")
    mine = asked.withColumns({"group": group, "wanted": F.lit(None).cast("array<bigint>")}).select(*columns)
    blank = {c: F.lit(None).cast(queries.schema[c].dataType) for c in facts}
    theirs = chosen.join(by_shuffle(candidates.select("split", "block", "id", "matrix")), ["split", "block"])
    rows = mine.unionByName(theirs.withColumns(blank).select(*columns))
    # The query blocks of a group come before its candidates.
    part = numbers[F.pmod(F.xxhash64("split") + F.col("group"), F.lit(parts)).cast("int")]
    return rows.withColumns({"_after": F.col("wanted").isNotNull(), "_part": part}).repartition(
        parts, "_part"
    ).drop("_part").sortWithinPartitions("split", "group", "_after")


def _meetings(
    batches: Iterator[pd.DataFrame], begin: Callable, read: Callable, meet: Callable, end: Callable
) -> Iterator[pd.DataFrame]:
    """What ``end`` makes of each query block after it met the candidate blocks that it wants.

    A task holds the query blocks of one group at a time (rows of ``_side_by_side``), as ``begin``
    makes them, and one candidate block, as ``read`` makes it.
    """
    group, held = None, {}
    for batch in batches:
        for row in batch.itertuples(index=False, name="Block"):
            if group != (row.split, row.group):
                yield from map(end, held.values())
                group, held = (row.split, row.group), {}
            if row.wanted is None:
                held[row.block] = begin(row)
            else:
                other = read(row)
                for block in row.wanted:
                    meet(held[block], other)
    yield from map(end, held.values())


class _Vectors:
    """The ids and vectors of a block, and the largest norm among its finite rows."""

    def __init__(self, ids, matrix: bytes, form: str):
        self.ids = np.asarray(ids)
        self.exact = np.frombuffer(matrix, form).reshape(len(self.ids), -1)
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.linalg.norm(self.exact.astype(np.float64), axis=1)
            self.fast = self.exact.astype(np.float32, copy=False)
        self.norm = float(norms[np.isfinite(norms)].max(initial=0.0))

    def by_id(self) -> _Vectors:
        out, order = object.__new__(_Vectors), np.argsort(self.ids, kind="stable")
        out.ids, out.exact, out.fast, out.norm = self.ids[order], self.exact[order], self.fast[order], self.norm
        return out


def _pieces(mine: _Vectors, other: _Vectors) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
    """Products of two blocks, piece by piece, and how far rounding can take one of them.

    In single precision where it can hold them; what is close to a bound is worked out anew by ``_exact``.
    """
    reach = mine.norm * other.norm
    single = reach < 1e30
    a, b = (mine.fast, other.fast) if single else (mine.exact.astype(np.float64), other.exact.astype(np.float64))
    room = (a.shape[1] + 4) * (2.0**-23 if single else 2.0**-52) * reach
    for left in range(0, len(a), SLICE_ROWS):
        for right in range(0, len(b), PIECE_ROWS):
            rows, columns = slice(left, left + SLICE_ROWS), slice(right, right + PIECE_ROWS)
            with np.errstate(over="ignore", invalid="ignore"):
                yield rows, columns, a[rows] @ b[columns].T, room


def _all_exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(a.astype(np.float64) @ b.astype(np.float64).T, SIM_DIGITS)


def _exact(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Similarities of chosen pairs of rows."""
    out = np.empty(len(at))
    for lo in range(0, len(at), EXACT_ROWS):
        part = slice(lo, lo + EXACT_ROWS)
        out[part] = np.einsum("ij,ij->i", a[at[part]].astype(np.float64), b[to[part]].astype(np.float64))
    return np.round(out, SIM_DIGITS)


def _counted(mask: np.ndarray) -> np.ndarray:
    """True entries of each row."""
    return np.bitwise_count(np.packbits(mask, axis=1)).sum(axis=1, dtype=np.int64)


def _count_above(mine: _Vectors, level: np.ndarray, greater: np.ndarray, equal: np.ndarray, other: _Vectors) -> None:
    """Add to each row how many similarities to another block lie above its level, and at it."""
    for rows, columns, sims, room in _pieces(mine, other):
        own = level[rows]
        edge = room + 10.0**-SIM_DIGITS + np.abs(own) * 2.0**-22
        above = sims > (own + edge).astype(sims.dtype)[:, None]
        unsure = (sims >= (own - edge).astype(sims.dtype)[:, None]) ^ above
        greater[rows] += _counted(above)
        hits = np.flatnonzero(unsure)
        if len(hits) == 0:
            continue
        a, b, n = mine.exact[rows], other.exact[columns], sims.shape[1]
        if len(hits) > sims.size >> EXACT_SHARE:
            exact = np.where(unsure, _all_exact(a, b), -np.inf)
            greater[rows] += _counted(exact > own[:, None] + 5e-7)
            equal[rows] += _counted(np.abs(exact - own[:, None]) <= 5e-7)
            continue
        at, to = np.divmod(hits, n)
        exact = _exact(a, b, at, to)
        greater[rows] += np.bincount(at[exact > own[at] + 5e-7], minlength=len(own))
        equal[rows] += np.bincount(at[np.abs(exact - own[at]) <= 5e-7], minlength=len(own))


def _kind(vectors: DataFrame) -> str:
    return "<f4" if dict(vectors.dtypes)["vec"] == "array<float>" else "<f8"


def rank_of_gold(queries: DataFrame, candidates: DataFrame, rows_per_block: int = PAIR_BLOCK_ROWS) -> DataFrame:
    """Rank of each query's own counterpart: 1 + #greater + (#equal - 1) / 2.

    Both sides hold ``id, split, vec``; the gold candidate carries the query's id.  Similarities
    are compared at 6 decimals.
    """
    gold = queries.join(
        by_shuffle(candidates.select("id", "split", F.col("vec").alias("_g"))), ["id", "split"]
    ).select(
        "id", "split", "vec", F.round(V.dot(F.col("vec"), F.col("_g")), SIM_DIGITS).alias("gold")
    )

    form = _kind(queries)

    def begin(row):
        mine, gold = _Vectors(row.id, row.matrix, form), np.asarray(row.gold, np.float64)
        return mine, gold, np.zeros(len(gold), np.int64), np.zeros(len(gold), np.int64)

    def end(state) -> pd.DataFrame:
        mine, _, greater, equal = state
        return pd.DataFrame({"id": mine.ids, "greater": greater, "equal": equal})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _meetings(
            batches, begin, lambda row: _Vectors(row.id, row.matrix, form), lambda state, other: _count_above(*state, other), end
        )

    rows = candidates.select("id", "split", "vec")
    pivots = _pivots(rows, rows_per_block)
    mine = _packed(gold, rows_per_block, "gold", pivots=pivots)
    theirs = _packed(rows, rows_per_block, pivots=pivots)
    levels = _outline(mine, F.array_min("gold").alias("least"), F.array_max("gold").alias("most"))
    pairs = _bounded_pairs(levels, _outline(theirs))
    # A block whose rows are all above every gold is counted whole, one all below is not needed.
    above = pairs.filter(F.col("lower") > F.col("most")).groupBy("split", "block").agg(F.sum("o_rows").alias("greater"))
    sure = mine.select("split", "block", "id").join(above, ["split", "block"]).select(
        F.explode("id").alias("id"), "greater", F.lit(0).cast("long").alias("equal")
    )
    open_ = pairs.filter((F.col("lower") <= F.col("most")) & (F.col("upper") >= F.col("least")))
    kind = queries.schema["id"].dataType.simpleString()
    counts = _side_by_side(open_, mine, theirs, "gold").mapInPandas(compare, f"id {kind}, greater long, equal long")
    return counts.unionByName(sure).groupBy("id").agg(
        (1 + F.sum("greater") + (F.sum("equal") - 1) / 2).alias("rank")
    )


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """n, MRR, recall at 1 and 10, median rank."""
    facts = ranks.agg(
        F.avg(1.0 / F.col("rank")).alias("mrr"),
        F.avg((F.col("rank") <= 1).cast("double")).alias("recall_1"),
        F.avg((F.col("rank") <= 10).cast("double")).alias("recall_10"),
    )
    middle = quantiles(ranks, "rank", {"median_rank": 0.5})
    return middle.join(F.broadcast(facts), F.lit(True))


class _Best:
    """The ``k`` best others of each row of a block; ``bars``: scores below which none is needed."""

    def __init__(self, key: tuple, mine: _Vectors, k: int, bars: np.ndarray | None = None):
        self.key, self.mine, self.k = key, mine, k
        self.bar = np.full(len(mine.ids), -np.inf) if bars is None else bars
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def meet(self, other: _Vectors) -> None:
        """``other``'s rows in the order of their ids."""
        mine = self.mine
        first, last = (np.searchsorted(other.ids, mine.ids, side) for side in ("left", "right"))
        last = np.where(mine.ids == mine.ids, last, first)  # noqa: PLR0124  (NaN stands for null, unlike any other)
        for rows, columns, sims, room in _pieces(mine, other):
            bar, n = self.bar[rows], sims.shape[1]
            # A row is no neighbour of its own.
            for i in np.flatnonzero((first[rows] < columns.start + n) & (last[rows] > np.maximum(first[rows], columns.start))):
                sims[i, max(first[rows][i] - columns.start, 0) : last[rows][i] - columns.start] = -np.inf
            dense = np.isneginf(bar).any()
            if not dense:
                edge = (bar - room - 10.0**-SIM_DIGITS - np.abs(bar) * 2.0**-22).astype(sims.dtype)
                hits = np.flatnonzero(sims >= edge[:, None])
                dense = len(hits) > sims.size >> EXACT_SHARE
            a, b = mine.exact[rows], other.exact[columns]
            if dense:
                scores = np.where(np.isneginf(sims), -np.inf, _all_exact(a, b))
                scores[~np.isfinite(scores) | (scores < bar[:, None])] = -np.inf
                to = _first_k(scores, self.k)
                at = np.repeat(np.arange(len(to)), to.shape[1])
                to = to.ravel()
                score = scores[at, to]
            else:
                at, to = np.divmod(hits, n)
                score = _exact(a, b, at, to)
            keep = np.isfinite(score) & (score >= bar[at])
            if keep.any():
                at, to = at[keep], to[keep]
                held = self.held.setdefault(rows.start, [])
                held.append((at, score[keep], other.ids[columns][to]))
                if dense or sum(len(x[0]) for x in held) > 2 * self.k * SLICE_ROWS:
                    self._merge(rows.start)

    def _merge(self, start: int) -> None:
        at, score, ids = (np.concatenate(x) for x in zip(*self.held[start], strict=True))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        full = place == self.k - 1
        self.bar[start + at[full]] = np.maximum(self.bar[start + at[full]], score[full])
        keep = place < self.k
        self.held[start] = [(at[keep], score[keep], ids[keep])]

    def found(self) -> pd.DataFrame:
        for start in self.held:
            self._merge(start)
        parts = [(start + at, score, ids) for start, ((at, score, ids),) in self.held.items()]
        parts = parts or [(np.zeros(0, int), np.zeros(0), self.mine.ids[:0])]
        at, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({
            "split": self.key[0], "block": self.key[1], "id": self.mine.ids[at], "neighbour": ids, "score": score,
        })


def _best(form: str, k: int):
    """Rows of ``_side_by_side`` to candidates for the ``k`` best others of each query."""

    def begin(row) -> _Best:
        mine = _Vectors(row.id, row.matrix, form)
        known = {} if getattr(row, "known", None) is None else dict(zip(row.known, row.bars, strict=True))
        return _Best((row.split, row.block), mine, k, np.array([known.get(i, -np.inf) for i in mine.ids.tolist()], np.float64))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _meetings(batches, begin, lambda row: _Vectors(row.id, row.matrix, form).by_id(), _Best.meet, _Best.found)

    return best


def _best_at_home(form: str, k: int):
    """Blocks to the ``k`` best others that each query has in its own."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name="Block"):
                mine = _Vectors(row.id, row.matrix, form).by_id()
                best = _Best((row.split, row.block), mine, k)
                best.meet(mine)
                yield best.found()

    return best


def _neighbour_pairs(packed: DataFrame, home: DataFrame, k: int) -> DataFrame:
    """Pairs of different blocks that can hold a neighbour better than the ``k`` found at home: those
    whose upper bound reaches the worst k-th score of the query block."""
    worst = home.groupBy("split", "block", "id").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    bars = worst.groupBy("split", "block").agg(
        F.min(F.when(F.col("n") < k, F.lit(float("-inf"))).otherwise(F.col("score"))).alias("bar")
    )
    outline = _outline(packed)
    asked = outline.join(bars, ["split", "block"], "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    return _bounded_pairs(asked, outline).filter((F.col("block") != F.col("other")) & (F.col("upper") >= F.col("bar")))


def _at_home(vectors: DataFrame, k: int, rows_per_block: int) -> tuple[DataFrame, DataFrame, str]:
    """Blocks around pivots, and the best ``k`` that each row has in its own block."""
    spark, form = vectors.sparkSession, _kind(vectors)
    packed = _packed(vectors, rows_per_block, pivots=_pivots(vectors, rows_per_block))
    kinds = dict(vectors.dtypes)
    schema = f"split {kinds['split']}, block int, id {kinds['id']}, neighbour {kinds['id']}, score double"
    alone = packed.select("split", "block", "id", "matrix")
    home = storage.save(alone.mapInPandas(_best_at_home(form, k), schema), storage.new_path(spark, "home-neighbours"))
    return packed, home, schema


def nearest_neighbours(vectors: DataFrame, k: int = 25, rows_per_block: int = PAIR_BLOCK_ROWS) -> DataFrame:
    """The ``k`` most similar other rows per row (``id, split, vec``), ties by id.

    Rows gather in blocks around pivots.  Each is first compared with its own block; the scores found
    there shut out every other block whose bound lies below, so only block pairs that can matter
    are multiplied.  ``pair_report`` tells how many.
    """
    packed, home, schema = _at_home(vectors, k, rows_per_block)
    pairs = _neighbour_pairs(packed, home, k)
    known = home.groupBy("split", "block", "id").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k)
    known = known.groupBy("split", "block").agg(F.collect_list(F.struct("id", "bar")).alias("b")).select(
        "split", "block", F.col("b.id").alias("known"), F.col("b.bar").alias("bars")
    )
    asking = packed.join(by_shuffle(known), ["split", "block"], "left")
    # A task holds twice as many scores and ids as it ends with.
    both = _side_by_side(pairs, asking, packed, "known", "bars", held=6 * k)
    found = both.mapInPandas(_best(_kind(vectors), k), schema).unionByName(home)
    # Spark keeps the best k of each task before this exchange.
    w = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return found.select("id", "neighbour", "score").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def pair_report(vectors: DataFrame, k: int = 25, rows_per_block: int = PAIR_BLOCK_ROWS) -> DataFrame:
    """split, blocks, visited: block pairs that ``nearest_neighbours`` multiplies, of blocks squared."""
    packed, home, _ = _at_home(vectors, k, rows_per_block)
    visited = _neighbour_pairs(packed, home, k).groupBy("split").agg(F.count("*").alias("v"))
    return packed.groupBy("split").agg(F.count("*").alias("blocks")).join(visited, "split", "left").select(
        "split", "blocks", (F.coalesce("v", F.lit(0)) + F.col("blocks")).alias("visited")
    )


def _first_k(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, ties by column."""
    if k >= sims.shape[1]:
        return np.argsort(-sims, axis=1, kind="stable")[:, :k]
    level = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(sims), k), np.int64)
    for i, (row, edge) in enumerate(zip(sims, level, strict=True)):
        at = np.flatnonzero(row >= edge)
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def nearest_by_signature(
    vectors: DataFrame, k: int = 25, bits: int = 8, tables: int = 4, seed: int = 3,
    rows_per_block: int = PAIR_BLOCK_ROWS,
) -> DataFrame:
    """Approximate neighbours: only vectors that share a sign pattern are compared.

    ``tables`` patterns of ``bits`` random hyperplanes each; the exact search then runs inside
    each pattern.  Columns as in ``nearest_neighbours``; a row may have fewer than ``k``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            matrix = np.stack(batch["vec"].to_numpy()).astype(np.float64)
            for t in range(tables):
                planes = np.random.default_rng(seed + t).normal(size=(matrix.shape[1], bits))
                code = ((matrix @ planes) > 0) @ (1 << np.arange(bits))
                names = [f"{s}/{t}/{c}" for s, c in zip(batch["split"], code, strict=True)]
                yield batch.assign(split=names)

    named = vectors.select("id", F.col("split").cast("string").alias("split"), "vec").mapInPandas(
        signed, f"id {kinds['id']}, split string, vec {kinds['vec']}"
    )
    # A pair may meet in every table, so k places a table hold the best k pairs.
    near = nearest_neighbours(named, k * tables, rows_per_block)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return (
        near.drop("place").dropDuplicates(["id", "neighbour"])
        .withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    )


def neighbour_scores(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean label of the neighbours per row and label (``labels``: id, label, value)."""
    # The labels of a row travel together, and are taken apart where the row's votes are added up.
    votes = labels.groupBy(F.col("id").alias("neighbour")).agg(
        F.collect_list(F.struct("label", F.col("value").alias("vote"))).alias("votes")
    )
    cast = neighbours.join(by_shuffle(votes), "neighbour").select("id", "votes").repartition("id")
    return (
        cast.select("id", F.inline("votes"))
        .groupBy("id", "label")
        .agg(F.avg("vote").alias("score"))
    )


def label_probe(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """AUC per label of the neighbour score."""
    scored = neighbour_scores(neighbours, labels).join(by_shuffle(labels), ["id", "label"])
    return auc(scored.withColumn("positive", F.col("value") > 0.5), "score", "positive", ["label"])


def macro_auc(per_label: DataFrame) -> DataFrame:
    """Mean over the labels whose AUC is defined."""
    return per_label.agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_labels"))


def phase_labels(seg: DataFrame) -> DataFrame:
    """Five any-true pass facts of the team in possession, per chain."""
    mine = (F.col("team_id") == F.col("chain_team_id")) & (F.col("type_id") == K.PASS)
    return seg.groupBy("match_id", "start_index").agg(
        *[
            F.coalesce(F.bool_or(mine & F.col(c)), F.lit(False)).alias(c)
            for c in K.PROBE_LABELS
        ]
    )


def label_matrix(labels: DataFrame, phases: DataFrame) -> DataFrame:
    """Labels aligned to phase ids."""
    ids = phases.select("match_id", "start_index", "phase_id")
    return ids.join(by_shuffle(labels), ["match_id", "start_index"]).select("phase_id", *K.PROBE_LABELS)


def unpivot_labels(matrix: DataFrame, id_col: str = "phase_id") -> DataFrame:
    values = [F.col(c).cast("double").alias(c) for c in K.PROBE_LABELS]
    return matrix.select(F.col(id_col).alias("id"), *values).unpivot(
        "id", list(K.PROBE_LABELS), "label", "value"
    )


def prevalence(long_labels: DataFrame) -> DataFrame:
    return long_labels.groupBy("label").agg(F.avg("value").alias("prevalence"))


def ship_decision(current: DataFrame, contender: DataFrame) -> DataFrame:
    """Three conditions over two one-row metric tables (mrr, recall_1, macro_auc)."""
    b = current.select(*[F.col(c).alias(f"b_{c}") for c in ("mrr", "recall_1", "macro_auc")])
    both = contender.join(F.broadcast(b), F.lit(True))
    c1 = F.col("mrr") >= 1.10 * F.col("b_mrr")
    c2 = F.col("recall_1") >= F.col("b_recall_1")
    c3 = F.col("macro_auc") >= F.col("b_macro_auc") - 0.010
    return both.select(
        F.when(F.col("b_mrr") != 0, F.col("mrr") / F.col("b_mrr")).alias("mrr_ratio"),
        c1.alias("better_mrr"),
        c2.alias("recall_kept"),
        c3.alias("transfer_kept"),
        (c1 & c2 & c3).alias("ship"),
    )
