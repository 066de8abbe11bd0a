"""Player freeze frames: orientation and the possession team's coordinate frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import geometry as G


def frame_scalars(frames: DataFrame) -> DataFrame:
    """Per frame: located dots, number of actor dots and where the first actor stands.

    Runs before the join with the events, so each array is walked once and the tests below are
    plain scalar expressions.  Frames without a located dot are dropped.
    """
    located = F.filter(
        "freeze_frame", lambda p: p["location"].isNotNull() & (F.size(p["location"]) > 0)
    )
    actors = F.filter("freeze_frame", lambda p: G.flag(p["actor"]))
    staged = frames.select(
        "match_id", "event_uuid", "visible_area", located.alias("dots"), actors.alias("_a")
    )
    at = F.try_element_at("_a", F.lit(1))["location"]
    return staged.filter(F.size("dots") > 0).select(
        "match_id",
        "event_uuid",
        "visible_area",
        "dots",
        F.size("_a").alias("n_actors"),
        F.try_element_at(at, F.lit(1)).alias("actor_x"),
        F.try_element_at(at, F.lit(2)).alias("actor_y"),
    )


def orientation() -> Column:
    """``event``, ``mirrored`` or ``unknown`` by where the single actor stands."""
    ax, ay, x, y = (F.col(c) for c in ("actor_x", "actor_y", "x", "y"))
    tol = K.ACTOR_TOLERANCE
    return (
        F.when(x.isNull() | (F.col("n_actors") != 1), "unknown")
        .when((F.abs(ax - x) <= tol) & (F.abs(ay - y) <= tol), "event")
        .when(
            (F.abs(ax - (K.EVENT_MIRROR_X - x)) <= tol)
            & (F.abs(ay - (K.EVENT_MIRROR_Y - y)) <= tol),
            "mirrored",
        )
        .otherwise("unknown")
    )


def is_paired() -> Column:
    """The actor sits exactly on the mirrored event: the opponent's frame was borrowed."""
    ax, ay, x, y = (F.col(c) for c in ("actor_x", "actor_y", "x", "y"))
    eps = K.PAIRED_EPS
    hit = (
        (F.col("n_actors") == 1)
        & (F.abs(ax - (K.EVENT_MIRROR_X - x)) < eps)
        & (F.abs(ay - (K.EVENT_MIRROR_Y - y)) < eps)
    )
    return F.coalesce(hit, F.lit(False))


def frame_flip(orient: Column, event_is_ours: Column) -> Column:
    return (orient != "mirrored") != event_is_ours


def teammate_is_ours(orient: Column, paired: Column, event_is_ours: Column) -> Column:
    """Does a dot's teammate flag mean the possession team?  Reversed for borrowed frames."""
    return event_is_ours != ((orient == "mirrored") & paired)


def canonical_dots(dots: Column, flip: Column, mate_is_ours: Column) -> Column:
    """array<struct(x, y, flags)>; flags 1 = possession team, 2 = actor, 4 = keeper."""

    def dot(p: Column) -> Column:
        x, y = p["location"][0], p["location"][1]
        bits = (
            F.when(G.flag(p["teammate"]) == mate_is_ours, 1).otherwise(0)
            + F.when(G.flag(p["actor"]), 2).otherwise(0)
            + F.when(G.flag(p["keeper"]), 4).otherwise(0)
        )
        return F.struct(
            F.when(flip, G.frame_mirror_x(x)).otherwise(x).cast("float").alias("x"),
            F.when(flip, G.frame_mirror_y(y)).otherwise(y).cast("float").alias("y"),
            bits.cast("short").alias("flags"),
        )

    return F.transform(dots, dot)


def canonical_area(area: Column, flip: Column) -> Column:
    """Mirror a flat polygon; an odd tail value is dropped, NULL becomes empty."""
    pairs = F.coalesce(area, F.array().cast("array<double>"))
    even = F.slice(pairs, F.lit(1), F.size(pairs) - F.size(pairs) % 2)

    def turned(v: Column, i: Column) -> Column:
        return F.when(~flip, v).when(i % 2 == 0, G.frame_mirror_x(v)).otherwise(G.frame_mirror_y(v))

    return F.transform(even, turned)


def canonicalize(framed: DataFrame) -> DataFrame:
    """``frame_scalars`` joined to their events -> phase-frame columns."""
    ours = F.col("team_id") == F.col("chain_team_id")
    staged = framed.withColumn("orientation", orientation()).withColumns(
        {
            "_flip": frame_flip(F.col("orientation"), ours),
            "_mate": teammate_is_ours(F.col("orientation"), is_paired(), ours),
        }
    )
    turned = staged.select(
        "match_id",
        "phase_id",
        "idx",
        "event_uuid",
        "event_index",
        "orientation",
        canonical_dots(F.col("dots"), F.col("_flip"), F.col("_mate")).alias("_d"),
        canonical_area(F.col("visible_area"), F.col("_flip")).alias("visible_area"),
    )
    return turned.select(
        "match_id",
        "phase_id",
        "idx",
        "event_uuid",
        "event_index",
        "orientation",
        F.size("_d").alias("n_players"),
        F.col("_d.x").alias("px"),
        F.col("_d.y").alias("py"),
        F.col("_d.flags").alias("flags"),
        "visible_area",
    )


def keeper_sides(framed: DataFrame) -> DataFrame:
    """Frames with one keeper dot, tallied by orientation, teammate flag and side."""
    keepers = F.filter("dots", lambda p: G.flag(p["keeper"]))
    one = framed.select(orientation().alias("orientation"), keepers.alias("_k")).filter(
        F.size("_k") == 1
    )
    keeper = F.col("_k")[0]
    tally = one.groupBy(
        "orientation",
        G.flag(keeper["teammate"]).alias("teammate"),
        F.when(keeper["location"][0] < 60, "near_0").otherwise("near_120").alias("side"),
    ).agg(F.count("*").alias("n"))
    totals = tally.groupBy("orientation").agg(F.sum("n").alias("total"))
    return tally.join(totals, "orientation").withColumn("share", F.col("n") / F.col("total"))
