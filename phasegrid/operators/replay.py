"""Playback on the real clock: ball key-frames, positions in time, current freeze frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions.scan import block_of, by_shuffle, join_fragments, ordered_scan
from phasegrid.operators.asof import as_of
from phasegrid.sources import storage

KEY = ["phase_id"]
FALLBACK_FLIGHT_S = 0.5
STALE_AFTER_S, STALE_FLOOR, STALE_FADE_S = 1.5, 0.32, 3.0
CURRENT_EPS = 1e-6


def ball_points(events: DataFrame) -> DataFrame:
    """Raw ball points with arrival times and whether each opens a new position."""
    kept = events.filter(
        (F.col("team_side") == "in_possession")
        & (F.col("type_id") != K.PRESSURE)
        & F.col("x").isNotNull()
        & F.col("y").isNotNull()
    ).select(
        *KEY,
        "idx",
        F.col("t_offset_s").cast("double").alias("t"),
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "end_x", "end_y")],
    )
    has_end = F.col("end_x").isNotNull() & F.col("end_y").isNotNull()
    linked = ordered_scan(
        kept,
        KEY,
        "idx",
        lag={
            "was_x": F.when(has_end, F.col("end_x")).otherwise(F.col("x")),
            "was_y": F.when(has_end, F.col("end_y")).otherwise(F.col("y")),
        },
        lead={"next_t": F.col("t")},
    )
    arrival = F.when(F.col("next_t") > F.col("t"), F.col("next_t")).otherwise(
        F.col("t") + FALLBACK_FLIGHT_S
    )
    moved = F.col("was_x").isNull() | (F.col("x") != F.col("was_x")) | (F.col("y") != F.col("was_y"))
    travelled = (F.col("end_x") != F.col("x")) | (F.col("end_y") != F.col("y"))
    points = F.array(
        F.struct(
            (F.col("idx") * 2).alias("pos"), "t", "x", "y", moved.cast("int").alias("opens")
        ),
        F.when(
            has_end,
            F.struct(
                (F.col("idx") * 2 + 1).alias("pos"),
                arrival.alias("t"),
                F.col("end_x").alias("x"),
                F.col("end_y").alias("y"),
                travelled.cast("int").alias("opens"),
            ),
        ),
    )
    return linked.select(*KEY, F.explode(F.array_compact(points)).alias("p")).select(*KEY, "p.*")


def ball_keyframes(events: DataFrame, path: str | None = None) -> DataFrame:
    """Key-frames ``(phase_id, pos, t, x, y)``: repeated points collapsed to the earlier time,
    time made monotone.

    The collapsed points are written once (three ordered scans would otherwise recompute each
    other's input).
    """
    spark = events.sparkSession
    numbered = ordered_scan(ball_points(events), KEY, "pos", sums={"run": F.col("opens")})
    runs = numbered.groupBy(*KEY, "run").agg(
        F.min("pos").alias("pos"),
        F.min("t").alias("raw_t"),
        F.min_by("x", "pos").alias("x"),
        F.min_by("y", "pos").alias("y"),
    )
    saved = storage.save(runs, path or storage.new_path(spark, "keyframes"))
    timed = ordered_scan(saved, KEY, "pos", maxima={"t": F.col("raw_t")})
    return timed.select(*KEY, "pos", "t", "x", "y")


def ball_positions(keys: DataFrame, phases: DataFrame, step_s: float = 1.0) -> DataFrame:
    """Ball position at every multiple of ``step_s`` until the playback ends.

    Each key-frame emits the grid times that fall between it and its predecessor, so nothing is
    grouped per phase.  Times before the first or after the last key-frame are clamped.
    """
    ends = keys.groupBy(*KEY).agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), (F.max("pos") + 1).alias("_size")
    )
    step = F.lit(float(step_s))
    duration = F.col("duration_s").cast("double")
    length = phases.select(*KEY, duration.alias("duration")).join(by_shuffle(ends), KEY)
    length = length.select(
        *KEY,
        "first_t",
        "last_t",
        "_size",
        F.floor(F.greatest("duration", "last_t", F.lit(0.5)) / step).alias("steps"),
    )
    linked = ordered_scan(
        keys,
        KEY,
        "pos",
        lag={"pt": F.col("t"), "px": F.col("x"), "py": F.col("y")},
        lead={"nt": F.col("t")},
    ).withColumn("_b", block_of(F.col("pos")))
    linked = join_fragments(linked, length, KEY, "_b", "_size")
    first, final = F.col("pt").isNull(), F.col("nt").isNull()
    lo = F.when(first, F.lit(0).cast("long")).otherwise(F.floor(F.col("pt") / step))
    hi = F.when(final, F.col("steps")).otherwise(F.ceil(F.col("t") / step))
    grid = (
        linked.withColumns({"_lo": lo, "_hi": F.least(hi, F.col("steps"))})
        .filter(F.col("_lo") <= F.col("_hi"))
        .withColumn("_step", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("at", F.col("_step") * step)
    )
    at, t = F.col("at"), F.col("t")
    # Up to the first time: the first key-frame.  From the last time on: the last one.  Between:
    # the first key-frame at or after ``at`` closes the segment.
    covered = (
        (first & (at <= t))
        | (final & (at >= t) & (at > F.col("first_t")))
        | (~first & (at > F.col("pt")) & (at <= t) & (at < F.col("last_t")))
    )
    u = F.when(first | (at >= t), F.lit(1.0)).otherwise((at - F.col("pt")) / (t - F.col("pt")))
    x0, y0 = F.coalesce("px", "x"), F.coalesce("py", "y")
    return grid.filter(covered).select(
        *KEY,
        "at",
        (x0 + (F.col("x") - x0) * u).alias("x"),
        (y0 + (F.col("y") - y0) * u).alias("y"),
    )


def timed_frames(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames stamped with their event's time (0 where the event is missing)."""
    times = events.select(
        "match_id", *KEY, "event_uuid", F.col("t_offset_s").cast("double").alias("t")
    )
    return frames.join(by_shuffle(times), ["match_id", *KEY, "event_uuid"], "left").withColumn(
        "t", F.coalesce("t", F.lit(0.0))
    )


def current_frames(timed: DataFrame, phases: DataFrame, step_s: float = 1.0, slices: int | None = None) -> DataFrame:
    """As-of: the last frame at or before every grid time, with its age and opacity."""
    step = F.lit(float(step_s))
    steps = F.floor(F.greatest(F.col("duration_s").cast("double"), F.lit(0.5)) / step)
    grid = phases.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("_step")).select(
        *KEY, (F.col("_step") * step).alias("at")
    )
    frames = timed.select(*KEY, "idx", "t")
    rows = as_of(grid, frames, KEY, F.col("at") + CURRENT_EPS, F.col("t"), F.col("idx"), slices)
    age = F.col("at") - F.col("t")
    return rows.filter(F.col("t").isNotNull()).select(
        *KEY, "at", "idx", age.alias("age"), opacity(age).alias("opacity")
    )


def opacity(age):
    """1 while fresh, then fading to a floor."""
    faded = F.lit(1.0) - (age - STALE_AFTER_S) / STALE_FADE_S
    return F.when(age <= STALE_AFTER_S, F.lit(1.0)).otherwise(
        F.greatest(F.lit(STALE_FLOOR), faded)
    )


def trail(keys: DataFrame, times: DataFrame) -> DataFrame:
    """Key-frames passed up to ``at``, then the ball's own place then (``head``, no ``pos``).

    ``times`` holds one ``at`` per phase.  Before the first key-frame the head waits there, after
    the last one it stays there, and between two it is on the line.
    """
    sizes = keys.groupBy(*KEY).agg((F.max("pos") + 1).alias("_size"))
    linked = ordered_scan(
        keys, KEY, "pos", lag={"pt": F.col("t")},
        lead={"nt": F.col("t"), "nx": F.col("x"), "ny": F.col("y")},
    ).withColumn("_b", block_of(F.col("pos")))
    rows = join_fragments(linked, times.join(by_shuffle(sizes), KEY), KEY, "_b", "_size")
    at, t = F.col("at"), F.col("t")
    passed = t <= at
    # The last key-frame passed carries the head, or the first one if none is passed yet.
    leads = (passed & (F.col("nt").isNull() | (F.col("nt") > at))) | (~passed & F.col("pt").isNull())
    u = F.when(~passed | F.col("nt").isNull(), F.lit(0.0)).otherwise((at - t) / (F.col("nt") - t))

    def between(a: str, b: str) -> Column:
        return F.col(a) + (F.coalesce(b, a) - F.col(a)) * u

    here = F.struct(F.lit(False).alias("head"), "pos", "t", "x", "y")
    head = F.struct(
        F.lit(True).alias("head"), F.lit(None).cast("long").alias("pos"), at.alias("t"),
        between("x", "nx").alias("x"), between("y", "ny").alias("y"),
    )
    points = F.array_compact(F.array(F.when(passed, here), F.when(leads, head)))
    return rows.select(*KEY, "at", F.explode(points).alias("p")).select(*KEY, "at", "p.*")


def markers(events: DataFrame) -> DataFrame:
    """Timeline ticks: every event but Pressure and Ball Receipt*."""
    return events.filter(~F.col("type_id").isin(K.PRESSURE, K.BALL_RECEIPT))
