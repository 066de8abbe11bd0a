"""Cut ordered match events into possession chains (run-length, not group-by)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions.geometry import is_admin
from phasegrid.functions.scan import block_of, ordered_scan

CHAIN = ["match_id", "start_index"]


def drop_shootout(events: DataFrame) -> DataFrame:
    return events.filter(F.col("period") != K.SHOOTOUT_PERIOD)


def segment(events: DataFrame) -> DataFrame:
    """Add the chain of every event: ``start_index``, 0-based ``idx``, start clock and team.

    A chain is a run of events with the same (period, possession) in ``index`` order.  Runs are
    found per block of index values; a run that crosses a block border is stitched through one
    summary row per block, so a match of any length spreads over as many tasks as it has blocks.
    First blocks inherit nothing and have no summary row to join.
    """
    kept = drop_shootout(events).withColumn("block", block_of(F.col("index")))
    w = Window.partitionBy("match_id", "block").orderBy("index")
    run_key = F.struct("period", "possession")

    def within_block(df: DataFrame) -> DataFrame:
        marked = df.withColumns(
            {"_rn": F.row_number().over(w).cast("long"), "_prev": F.lag(run_key).over(w)}
        )
        opens = F.col("_prev").isNull() | (F.col("_prev") != run_key)
        start = F.struct(
            F.col("index").alias("index"),
            F.col("_rn").alias("rn"),
            F.col("ts_s").alias("ts"),
            F.col("possession_team_id").alias("team"),
        )
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        return marked.withColumn(
            "_start", F.last(F.when(opens, start), ignorenulls=True).over(running)
        )

    narrow = within_block(
        kept.select(
            "match_id", "block", "index", "period", "possession", "ts_s", "possession_team_id"
        )
    )
    edges = narrow.groupBy("match_id", "block").agg(
        F.count("*").alias("n"),
        F.min_by(run_key, "index").alias("first_key"),
        F.max_by(run_key, "index").alias("last_key"),
        F.max_by("_start", "index").alias("last_start"),
    )
    we = Window.partitionBy("match_id").orderBy("block")
    edges = edges.withColumns(
        {
            "continues": F.coalesce(F.lag("last_key").over(we) == F.col("first_key"), F.lit(False)),
            "base": F.coalesce(
                F.sum("n").over(we.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        }
    )
    own = F.struct(
        F.col("last_start.index").alias("index"),
        (F.col("base") + F.col("last_start.rn")).alias("rn"),
        F.col("last_start.ts").alias("ts"),
        F.col("last_start.team").alias("team"),
    )
    # The block's final run began here unless the whole block continues an earlier run.
    began_here = ~(F.col("continues") & (F.col("last_start.rn") == 1))
    edges = edges.withColumn(
        "final_start",
        F.last(F.when(began_here, own), ignorenulls=True).over(
            we.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    carry = edges.select(
        "match_id",
        "block",
        "base",
        F.when(F.col("continues"), F.lag("final_start").over(we)).alias("inherited"),
    ).filter(F.col("base") > 0)

    joined = within_block(kept).join(carry, ["match_id", "block"], "left").withColumn(
        "base", F.coalesce("base", F.lit(0))
    )
    here = F.struct(
        F.col("_start.index").alias("index"),
        (F.col("base") + F.col("_start.rn")).alias("rn"),
        F.col("_start.ts").alias("ts"),
        F.col("_start.team").alias("team"),
    )
    resolved = joined.withColumn(
        "_at",
        F.when((F.col("_start.rn") == 1) & F.col("inherited").isNotNull(), F.col("inherited"))
        .otherwise(here),
    )
    return resolved.select(
        *[F.col(c) for c in events.columns],
        "block",
        F.col("_at.index").alias("start_index"),
        F.col("_at.ts").alias("chain_start_ts"),
        F.col("_at.team").alias("chain_team_id"),
        (F.col("base") + F.col("_rn") - F.col("_at.rn")).alias("idx"),
    )


def has_ball_content():
    """Aggregate over a chain: true when any event is located and not administrative."""
    return F.bool_or(F.col("x").isNotNull() & ~is_admin(F.col("type_id")))


def number_chains(chains: DataFrame) -> DataFrame:
    """1-based ``seq`` per match over surviving chains, plus the previous chain's facts."""
    return ordered_scan(
        chains,
        ["match_id"],
        "start_index",
        sums={"seq": F.lit(1).cast("long")},
        lag={"prev_team_id": F.col("team_id"), "prev_period": F.col("period")},
    )
