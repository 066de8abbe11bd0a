"""As-of join: the last row of one side at or before each row of the other.

Both sides go into one order of key and time and are dealt to slices by a range exchange, whose
bounds follow the rows: a key of any length, and any number of rows at one time, is spread over
slices of bounded size.  A scan carries the last row found over to the slices behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phasegrid.functions.scan import ordered_scan
from phasegrid.sources import storage


def as_of(
    left: DataFrame, right: DataFrame, key: Sequence[str], at: Column, time: Column, tie: Column,
    slices: int | None = None,
) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` (but its key) whose ``time`` is not above ``at``.

    Of rows of the same time the one of the greatest ``tie`` is last.  Left rows without such a row,
    without a time or with a null in the key have nulls; right rows without a time are never found.
    """
    keys = list(key)
    mine = F.struct(*[F.col(c) for c in left.columns if c not in keys], F.lit(True).alias("_left"))
    theirs = F.struct(*[F.col(c) for c in right.columns if c not in keys], F.lit(True).alias("_right"))
    empty = F.lit(None)

    def row(df: DataFrame, when: Column, side: int, order: Column, held: Column, own: Column) -> DataFrame:
        return df.select(
            *keys, when.cast("double").alias("_at"), F.lit(side).alias("_side"), order.alias("_tie"),
            held.alias("_held"), own.alias("_own"),
        )

    held_type, own_type = (df.select(s.alias("s")).schema["s"].dataType for df, s in ((right, theirs), (left, mine)))
    tie_type = right.select(tie.alias("t")).schema["t"].dataType
    known = right.filter(time.isNotNull())
    both = row(known, time, 0, tie, theirs, empty.cast(own_type)).unionByName(
        row(left, at, 1, empty.cast(tie_type), empty.cast(held_type), mine)
    )
    order = [*keys, "_at", "_side", "_tie"]
    dealt = both.repartitionByRange(slices, *order) if slices else both.repartitionByRange(*order)
    # Range bounds are sampled, so the slices are written before two plans read them.
    laid = storage.save(
        dealt.withColumns({"_slice": F.spark_partition_id(), "_pos": F.struct("_at", "_side", "_tie")}),
        storage.new_path(left.sparkSession, "as-of"),
    )
    found = ordered_scan(laid, keys, "_pos", last={"_found": F.col("_held")}, block="_slice").filter("_side = 1")
    more = [F.col(f"_found.{c}").alias(c) for c in right.columns if c not in keys]
    return found.select(*[F.col(c) if c in keys else F.col(f"_own.{c}").alias(c) for c in left.columns], *more)
