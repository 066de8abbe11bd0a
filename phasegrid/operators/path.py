"""Ball path of a chain: points, arc length and even resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions.geometry import is_admin
from phasegrid.functions.scan import block_of, by_shuffle
from phasegrid.operators.spacing import without_repeats

SAME_POINT = 0.01


def on_path(ours: Column) -> Column:
    """Located event of the team in possession, neither Pressure nor administrative."""
    return (
        ours
        & (F.col("type_id") != K.PRESSURE)
        & ~is_admin(F.col("type_id"))
        & F.col("x").isNotNull()
    )


def path_points(events: DataFrame, key: Sequence[str], ours: Column) -> DataFrame:
    """One row per path point: the event's location, then its end location where it has one.

    ``pos`` orders the points of a chain; ``block`` keeps long chains splittable.
    """
    return (
        events.filter(on_path(ours))
        .select(
            *key,
            block_of(F.col("idx")).alias("block"),
            F.explode(
                F.array(
                    F.struct((F.col("idx") * 2).alias("pos"), F.col("x"), F.col("y")),
                    F.struct(
                        (F.col("idx") * 2 + 1).alias("pos"),
                        F.col("end_x").alias("x"),
                        F.col("end_y").alias("y"),
                    ),
                )
            ).alias("p"),
        )
        .select(*key, "block", "p.pos", "p.x", "p.y")
        .filter(F.col("x").isNotNull())
    )


def _step(dx: Column, dy: Column) -> Column:
    moved = (F.abs(dx) > SAME_POINT) | (F.abs(dy) > SAME_POINT)
    return F.when(moved, F.hypot(dx, dy)).otherwise(F.lit(0.0))


def path_steps(points: DataFrame, key: Sequence[str]) -> DataFrame:
    """Segments between consecutive distinct points with their running arc length.

    Each point is compared with the one before it, which is right where ``points`` hold no point
    close to the last kept one (``spacing``) or sit on the 0.1 grid.  Chains of one block carry nothing.
    """
    keys = list(key)
    w = Window.partitionBy(*keys, "block").orderBy("pos")
    local = points.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).withColumn(
        "step",
        F.coalesce(_step(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)),
    )
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    edges = local.groupBy(*keys, "block").agg(
        F.sum("step").alias("length"),
        F.min_by("x", "pos").alias("first_x"),
        F.min_by("y", "pos").alias("first_y"),
        F.max_by("x", "pos").alias("last_x"),
        F.max_by("y", "pos").alias("last_y"),
    )
    we = Window.partitionBy(*keys).orderBy("block")
    edges = edges.withColumns(
        {"in_x": F.lag("last_x").over(we), "in_y": F.lag("last_y").over(we)}
    ).withColumn(
        "jump",
        F.coalesce(
            _step(F.col("first_x") - F.col("in_x"), F.col("first_y") - F.col("in_y")), F.lit(0.0)
        ),
    )
    carry = edges.select(
        *keys,
        "block",
        "in_x",
        "in_y",
        "jump",
        F.coalesce(
            F.sum(F.col("length") + F.col("jump")).over(
                we.rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0.0),
        ).alias("base"),
        F.sum(F.col("length") + F.col("jump")).over(Window.partitionBy(*keys)).alias("all"),
        F.count("*").over(Window.partitionBy(*keys)).alias("blocks"),
    ).filter(F.col("blocks") > 1)
    joined = local.withColumns(
        {"cum": F.sum("step").over(run), "alone": F.sum("step").over(Window.partitionBy(*keys, "block"))}
    ).withColumn("cum_before", F.lag("cum").over(w))
    joined = joined.join(carry, [*keys, "block"], "left").withColumns(
        {
            "base": F.coalesce("base", F.lit(0.0)),
            "jump": F.coalesce("jump", F.lit(0.0)),
            "total": F.coalesce("all", "alone"),
        }
    )
    first = F.col("px").isNull()
    return joined.select(
        *keys,
        "pos",
        F.coalesce("px", "in_x").alias("x0"),
        F.coalesce("py", "in_y").alias("y0"),
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.when(first, F.col("base"))
        .otherwise(F.col("base") + F.col("jump") + F.col("cum_before"))
        .alias("c0"),
        (F.col("base") + F.col("jump") + F.col("cum")).alias("c1"),
        "total",
    )


def path_ends(points: DataFrame, key: Sequence[str]) -> DataFrame:
    """First and last point of each path as ``sx, sy, ex, ey``."""
    return points.groupBy(*key).agg(
        F.min_by("x", "pos").alias("sx"),
        F.min_by("y", "pos").alias("sy"),
        F.max_by("x", "pos").alias("ex"),
        F.max_by("y", "pos").alias("ey"),
    )


def resample(
    points: DataFrame,
    key: Sequence[str],
    n: int = K.PATH_POINTS,
    ends: DataFrame | None = None,
) -> DataFrame:
    """``n`` points per chain, evenly spaced by arc length, as flat ``path_xy``.

    ``ends`` gives the first and last points where they are already known.
    Each segment emits only the sample positions that fall inside it, so at most ``n`` rows per
    chain reach the final grouping whatever the length of the chain.  End points are exact; a
    path without length repeats its point; ``n = 1`` gives the end point.  Points closer than
    ``SAME_POINT`` to the last one kept before them are left out, whether on the grid or not.
    """
    keys = list(key)
    points = without_repeats(points, keys, SAME_POINT)
    steps = path_steps(points, keys)
    last = n - 1
    lo = F.greatest(F.floor(F.col("c0") * last / F.col("total")).cast("int"), F.lit(1))
    hi = F.least(F.floor(F.col("c1") * last / F.col("total")).cast("int") + 1, F.lit(last - 1))

    def target(i: Column) -> Column:
        return F.col("total") * i / F.lit(max(last, 1))

    if n > 2:
        moving = steps.filter((F.col("c1") > F.col("c0")) & (F.col("total") > 0))
        hits = (
            moving.withColumn("_lo", lo)
            .withColumn("_hi", hi)
            .filter(F.col("_lo") <= F.col("_hi"))
            .withColumn("i", F.explode(F.sequence("_lo", "_hi")))
            .filter((target(F.col("i")) > F.col("c0")) & (target(F.col("i")) <= F.col("c1")))
        )
        t = (target(F.col("i")) - F.col("c0")) / (F.col("c1") - F.col("c0"))
        inner = (
            hits.select(
                *keys,
                F.struct(
                    "i",
                    (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"),
                    (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"),
                ).alias("s"),
            )
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list("s")).alias("inner"))
        )
    ends = path_ends(points, keys) if ends is None else ends
    start, end = F.array("sx", "sy"), F.array("ex", "ey")
    if n == 1:
        return ends.select(*keys, end.alias("path_xy"))
    if n == 2:
        return ends.select(*keys, F.concat(start, end).alias("path_xy"))
    flat = F.flatten(F.transform("inner", lambda s: F.array(s["x"], s["y"])))
    still = F.flatten(F.array_repeat(start, n))
    return ends.join(by_shuffle(inner), keys, "left").select(
        *keys,
        F.when(F.col("inner").isNull(), still)
        .otherwise(F.concat(start, flat, end))
        .alias("path_xy"),
    )


def thin_path(path: Column, index: Sequence[int] = K.TRAJECTORY_INDEX) -> Column:
    """Keep the (x, y) pairs at the given point positions of a flat path."""
    return F.array(*[path[2 * i + k] for i in index for k in (0, 1)])


def stride_keep(idx: Column, n: Column, max_len: int) -> Column:
    """True for the rows a uniform stride keeps: all if ``n <= max_len``, else rounded steps.

    Row ``idx`` is kept when some step ``round(i * (n-1) / (max_len-1))`` hits it, so only the
    two neighbouring steps need a look.
    """
    span = (n - 1).cast("double")
    guess = F.floor(idx * (max_len - 1) / F.greatest(span, F.lit(1.0)))
    hit = F.lit(False)
    for shift in (-1, 0, 1, 2):
        i = guess + shift
        valid = (i >= 0) & (i <= max_len - 1)
        # i * step, the way an evenly spaced grid is laid out; the last step is the end itself.
        at = F.when(i == max_len - 1, span).otherwise(i * (span / F.lit(float(max_len - 1))))
        hit = hit | (valid & (F.rint(at) == idx))
    return (n <= max_len) | hit
