"""Reading and slicing the published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.sources import snapshots

SPLIT_BUCKETS = 102
STORE_COLUMNS = (
    "phase_id", "idx", "t_offset_s", "type_id", "team_side", "player_name", "x", "y", "end_x",
    "end_y", "under_pressure", "counterpress", "out", "xg",
)


def register_views(tables) -> None:
    """Temp views over the published tables."""
    for name in ("matches", "phases", "phase_events", "phase_frames", "similarity"):
        getattr(tables, name).createOrReplaceTempView(name)


def phase_rows(table: DataFrame, match_id: int, phase_id: str) -> DataFrame:
    """Rows of one phase: one bucket is read, the id filters reach the scan."""
    return table.filter(
        (F.col("bucket") == snapshots.bucket_of(F.lit(match_id), snapshots.buckets_in(table)))
        & (F.col("match_id") == match_id)
        & (F.col("phase_id") == phase_id)
    ).orderBy("idx")


def match_rows(table: DataFrame, match_ids: Sequence[int], columns: Sequence[str] = STORE_COLUMNS) -> DataFrame:
    """Chosen columns of several matches, ordered."""
    n = snapshots.buckets_in(table)
    buckets = [snapshots.bucket_of(F.lit(m), n) for m in match_ids]
    return (
        table.filter(F.col("bucket").isin(*buckets) & F.col("match_id").isin(*match_ids))
        .select("match_id", *columns)
        .orderBy("match_id", "phase_id", "idx")
    )


def first_matches(matches: DataFrame, n: int) -> DataFrame:
    """The first ``n`` matches by date and id."""
    return matches.orderBy("match_date", "match_id").limit(n)


def only_matches(rows: DataFrame, matches: DataFrame) -> DataFrame:
    return rows.join(matches.select("match_id"), "match_id", "left_semi")


def split_of(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Attach a given match -> split table."""
    return rows.join(splits.select("match_id", "split"), "match_id")


def assign_splits(matches: DataFrame, seed: int, validation: int = 16, test: int = 16) -> DataFrame:
    """A new split by match from a hash bucket, stable under any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("match_id").cast("string"))
    bucket = F.pmod(
        F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(SPLIT_BUCKETS)
    )
    return matches.select(
        "match_id",
        F.when(bucket < test, "test")
        .when(bucket < test + validation, "validation")
        .otherwise("train")
        .alias("split"),
    )


def event_types(spark: SparkSession) -> DataFrame:
    rows = [(t, K.EVENT_TYPES[t], i + 1) for i, t in enumerate(K.TYPE_VOCABULARY)]
    return spark.createDataFrame(rows, "type_id int, type_name string, type_index int")
