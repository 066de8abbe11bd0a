"""Column expressions for pitch geometry, clocks and type-dispatched fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasegrid import constants as K


def _literal(value) -> str:
    return repr(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "\\'") + "'"


def lookup(column: Column, mapping: dict, default: Column | None = None) -> Column:
    """Map closed-set values through a constant map; unknown gives ``default`` or NULL.

    A map literal, not a CASE chain: generated code stays small enough to be compiled.
    """
    pairs = ", ".join(
        f"{_literal(k)}, {_literal(v)}{'D' if isinstance(v, float) else ''}"
        for k, v in mapping.items()
    )
    numeric = isinstance(next(iter(mapping)), int)
    expr = F.try_element_at(F.expr(f"map({pairs})"), column.cast("int" if numeric else "string"))
    return expr if default is None else F.coalesce(expr, default)


def clock_seconds(ts: Column) -> Column:
    """``HH:MM:SS.mmm`` to seconds within the period."""
    parts = F.split(ts, ":")
    return (
        parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("double")
    ).cast("double")


def absolute_seconds(period: Column, ts: Column) -> Column:
    return lookup(period, K.PERIOD_OFFSET_S) + ts


def mirror_x(x: Column) -> Column:
    return F.round(F.lit(K.EVENT_MIRROR_X) - x, 1)


def mirror_y(y: Column) -> Column:
    return F.round(F.lit(K.EVENT_MIRROR_Y) - y, 1)


def canonical_x(x: Column, flip: Column) -> Column:
    return F.when(flip, mirror_x(x)).otherwise(x)


def canonical_y(y: Column, flip: Column) -> Column:
    return F.when(flip, mirror_y(y)).otherwise(y)


def canonical_location(location: Column, flip: Column) -> Column:
    """struct(x, y, z) of a 2- or 3-element location; z is never mirrored."""
    return F.struct(
        canonical_x(F.try_element_at(location, F.lit(1)), flip).alias("x"),
        canonical_y(F.try_element_at(location, F.lit(2)), flip).alias("y"),
        F.try_element_at(location, F.lit(3)).alias("z"),
    )


def frame_mirror_x(x: Column) -> Column:
    return F.lit(K.PITCH_X) - x


def frame_mirror_y(y: Column) -> Column:
    return F.lit(K.PITCH_Y) - y


def third(x: Column) -> Column:
    return (
        F.when(x < K.MIDDLE_THIRD_X, "def_third")
        .when(x < K.FINAL_THIRD_X, "mid_third")
        .otherwise("final_third")
    )


def channel(y: Column) -> Column:
    return F.when(y < K.CHANNEL_1, "left").when(y < K.CHANNEL_2, "centre").otherwise("right")


def zone(x: Column, y: Column) -> Column:
    """Third and channel; a boundary belongs upfield and to the higher y."""
    return F.concat(third(x), F.lit("_"), channel(y))


def zone_third(zone_name: Column) -> Column:
    return F.concat(F.split_part(zone_name, F.lit("_"), F.lit(1)), F.lit("_third"))


def zone_channel(zone_name: Column) -> Column:
    return F.split_part(zone_name, F.lit("_"), F.lit(3))


def in_box(x: Column, y: Column) -> Column:
    return (x >= K.BOX_X_MIN) & y.between(K.BOX_Y_MIN, K.BOX_Y_MAX)


def _clamp(v: Column, size: float) -> Column:
    # ``greatest`` and ``least`` skip NULLs, and an unknown position has to stay unknown.
    held = F.least(F.greatest(v, F.lit(-K.PITCH_PAD)), F.lit(size + K.PITCH_PAD))
    return F.when(v.isNotNull(), held)


def clamp_x(x: Column) -> Column:
    """Freeze-frame coordinate held within the drawn margin; NULL stays NULL."""
    return _clamp(x, K.PITCH_X)


def clamp_y(y: Column) -> Column:
    return _clamp(y, K.PITCH_Y)


def flag(column: Column) -> Column:
    """Present-if-true flag: missing means false."""
    return F.coalesce(column.cast("boolean"), F.lit(False))


def phase_id(match_id: Column, seq: Column) -> Column:
    # Pads to four digits without cutting longer sequence numbers.
    return F.format_string("%d-%04d", match_id, seq)


def match_of(phase: Column) -> Column:
    return F.split_part(phase, F.lit("-"), F.lit(1)).cast("long")


def is_admin(type_id: Column) -> Column:
    return type_id.isin(*K.ADMIN_TYPES)


def zone_dimension(spark):
    """Nine-row zone table: zone, third, channel and its rectangle."""
    rows = [
        (f"{t}_{c}", t, c, i * 40.0, j * K.CHANNEL_1, 40.0, K.CHANNEL_1)
        for i, t in enumerate(K.THIRDS)
        for j, c in enumerate(K.CHANNELS)
    ]
    return spark.createDataFrame(
        rows, "zone string, third string, channel string, x double, y double, w double, h double"
    )
