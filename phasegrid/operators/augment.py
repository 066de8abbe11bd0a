"""Second views of a phase: crop, drop-out, jitter and tempo, each a row-wise job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.hashing import normal, uniform
from phasegrid.functions.scan import block_of, join_fragments, ordered_scan

KEY = ["phase_id"]


def _with_size(events: DataFrame) -> DataFrame:
    """Number of rows per phase on every row, and the rows' block."""
    rows = events.withColumn("_b", block_of(F.col("idx")))
    sizes = events.groupBy(*KEY).agg(
        F.count("*").alias("_n"), F.min("idx").alias("_first"), F.max("idx").alias("_last")
    )
    return join_fragments(rows, sizes, KEY, "_b")


def crop(events: DataFrame, seed: int, keep_min: float = 0.6) -> DataFrame:
    """A contiguous run of 60 to 100 % of each phase; under 4 events nothing is cut.

    ``idx`` must be 0-based and dense.
    """
    n = F.col("_n")
    share = F.lit(keep_min) + F.lit(1.0 - keep_min) * uniform(seed, "crop", "phase_id")
    sized = _with_size(events).withColumn(
        "_k", F.greatest(F.lit(3), F.bround(n * share)).cast("long")
    )
    placed = sized.withColumn(
        "_lo", F.floor(uniform(seed, "start", "phase_id") * (n - F.col("_k") + 1))
    )
    inside = (F.col("idx") >= F.col("_lo")) & (F.col("idx") < F.col("_lo") + F.col("_k"))
    return placed.filter((n < 4) | inside).select(*events.columns)


def drop_events(events: DataFrame, seed: int, p: float = 0.1) -> DataFrame:
    """Drop interior events with chance ``p``; ends stay, and at least 3 events stay."""
    if p <= 0:
        return events
    interior = (F.col("idx") > F.col("_first")) & (F.col("idx") < F.col("_last"))
    lost = interior & (uniform(seed, "drop", "phase_id", F.col("idx").cast("string")) < p)
    marked = _with_size(events).withColumn("_lost", lost)
    counted = ordered_scan(
        marked, KEY, "idx", totals={"_left": F.when(F.col("_lost"), 0).otherwise(1)}, block="_b"
    )
    applies = (F.col("_n") >= 5) & (F.col("_left") >= 3)
    return counted.filter(~(applies & F.col("_lost"))).select(*events.columns)


def jitter_locations(events: DataFrame, seed: int, sigma: float = 0.8) -> DataFrame:
    """Gaussian noise of ``sigma`` yards on every location that is present."""
    if sigma <= 0:
        return events
    idx = F.col("idx").cast("string")
    return events.withColumns(
        {
            c: F.col(c).cast("double") + F.lit(sigma) * normal(seed, c, "phase_id", idx)
            for c in ("x", "y", "end_x", "end_y")
        }
    )


def stretch_tempo(events: DataFrame, seed: int, sigma: float = 0.1) -> DataFrame:
    """Scale all gaps of a phase by one lognormal factor; the first time stays."""
    if sigma <= 0:
        return events
    first = events.groupBy(*KEY).agg(F.min_by("t_offset_s", "idx").cast("double").alias("_t0"))
    rows = join_fragments(events.withColumn("_b", block_of(F.col("idx"))), first, KEY, "_b")
    factor = F.exp(F.lit(sigma) * normal(seed, "tempo", "phase_id"))
    t = F.col("_t0") + (F.col("t_offset_s").cast("double") - F.col("_t0")) * factor
    return rows.withColumn("t_offset_s", t).select(*events.columns)


def augment(
    events: DataFrame,
    seed: int,
    keep_min: float = 0.6,
    drop_p: float = 0.1,
    jitter: float = 0.8,
    tempo: float = 0.1,
) -> DataFrame:
    """Crop, then drop-out, then jitter, then tempo."""
    out = crop(events, seed, keep_min)
    out = drop_events(out, seed, drop_p)
    return stretch_tempo(jitter_locations(out, seed, jitter), seed, tempo)
