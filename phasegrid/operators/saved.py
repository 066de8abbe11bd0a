"""Jobs over a table of saved queries.

A saved query is a row ``query_id, filters array<struct<field, op, values array<string>>>,
order_field, order_dir``; values are text (``true``/``false`` for flags).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.operators.search import ENUM_VALUES, FIELDS, allowed_ops, is_numeric

# Fields by control kind.
ENUM_FIELDS = ("outcome", "start_type", "start_zone", "end_zone", "competition", "team_name")
RANGE_FIELDS = (
    "duration_s", "n_passes", "progression_m", "xg", "pressure_events", "direct_speed_m_s",
    "minute",
)
BOOL_FIELDS = (
    "high_press_regain", "counterattack", "switch_of_play", "reached_final_third", "reached_box",
    "has_360",
)
# Display names and units.
FIELD_LABELS = {
    "phase_id": "Phase id", "match_id": "Match id", "possession": "Possession",
    "team_id": "Team id", "team_name": "Team", "period": "Period",
    "start_ts": "Start (s into period)", "end_ts": "End (s into period)", "minute": "Minute",
    "competition": "Competition", "start_zone": "Start zone", "end_zone": "End zone",
    "duration_s": "Duration", "n_passes": "Passes", "n_events": "Events",
    "n_players": "Players involved", "start_type": "Start type", "outcome": "Outcome",
    "progression_m": "Progression", "direct_speed_m_s": "Direct speed",
    "pressure_events": "Pressure events", "high_press_regain": "High turnover",
    "counterattack": "Counterattack", "switch_of_play": "Switch of play",
    "reached_final_third": "Reached final third", "reached_box": "Reached the box", "xg": "xG",
    "has_360": "Has 360 data", "frame_coverage": "360 coverage",
}
UNITS = {"duration_s": "s", "progression_m": "m", "direct_speed_m_s": "m/s"}
VALUE_TEXT = {
    "kick_off": "kick-off", "goal_kick": "goal kick", "free_kick": "free kick",
    "throw_in": "throw-in", "turnover_open_play": "open-play turnover",
    "regular": "same-team restart", "shot_on_target": "shot on target",
    "shot_off_target": "shot off target", "lost_ball": "lost the ball",
    "out_of_play": "out of play", "foul_won": "foul won", "end_of_period": "end of period",
}
THIRD_TEXT = {
    "def_third": "defensive third", "mid_third": "middle third", "final_third": "final third",
}
_FILTER = "struct<field: string, op: string, values: array<string>>"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _last(field: str, ops) -> str:
    return f"try_element_at(filter(filters, f -> f.field = '{field}' AND f.op IN {_in(ops)}), -1)"


def _struct(field: str, op: str, values: str) -> str:
    return f"named_struct('field', '{field}', 'op', {op}, 'values', {values})"


def canonical_filters() -> Column:
    """One normal form per query: flags as ``eq``, one-value sets as ``eq``, bounds as ``between``.

    The last filter on a control wins; filters without a control pass through in front.
    """
    parts = []
    for f in BOOL_FIELDS:
        last = _last(f, ("eq", "neq"))
        value = (
            f"CASE WHEN ({last}).op = 'eq' THEN ({last}).values[0]"
            f" WHEN ({last}).values[0] = 'true' THEN 'false' ELSE 'true' END"
        )
        parts.append(f"CASE WHEN {last} IS NOT NULL THEN {_struct(f, repr('eq'), f'array({value})')} END")
    for f in ENUM_FIELDS:
        last = _last(f, ("eq", "in"))
        op = f"CASE WHEN size(({last}).values) = 1 THEN 'eq' ELSE 'in' END"
        parts.append(f"CASE WHEN {last} IS NOT NULL THEN {_struct(f, op, f'({last}).values')} END")
    for f in RANGE_FIELDS:
        fix = (
            (lambda v: f"CAST(CAST(floor(CAST({v} AS DOUBLE) + 0.5D) AS BIGINT) AS STRING)")
            if FIELDS[f] == "int"
            else (lambda v: v)
        )
        low = fix(f"({_last(f, ('gte', 'between'))}).values[0]")
        top = _last(f, ("lte", "between"))
        high = fix(f"try_element_at(({top}).values, -1)")
        parts.append(
            f"CASE WHEN {low} IS NOT NULL AND {high} IS NOT NULL THEN"
            f" {_struct(f, repr('between'), f'array({low}, {high})')}"
            f" WHEN {low} IS NOT NULL THEN {_struct(f, repr('gte'), f'array({low})')}"
            f" WHEN {high} IS NOT NULL THEN {_struct(f, repr('lte'), f'array({high})')} END"
        )
    controlled = (
        f"(f.field IN {_in(BOOL_FIELDS)} AND f.op IN ('eq', 'neq'))"
        f" OR (f.field IN {_in(ENUM_FIELDS)} AND f.op IN ('eq', 'in'))"
        f" OR (f.field IN {_in(RANGE_FIELDS)} AND f.op IN ('gte', 'lte', 'between'))"
    )
    return F.expr(
        f"concat(filter(filters, f -> NOT ({controlled})), array_compact(array({', '.join(parts)})))"
    ).cast(f"array<{_FILTER}>")


def canonicalize(saved: DataFrame) -> DataFrame:
    return saved.withColumn("filters", canonical_filters())


def query_key() -> Column:
    """Identity of a query: its filters in any order plus its ordering, never its limit."""
    return F.expr(
        "sha2(to_json(named_struct('f', array_sort(transform(filters,"
        " f -> concat_ws('|', f.field, f.op, to_json(f.values)))),"
        " 'o', coalesce(concat_ws('|', order_field, order_dir), ''))), 256)"
    )


def group_by_key(saved: DataFrame) -> DataFrame:
    """Saved queries grouped by identity."""
    return saved.withColumn("query_key", query_key()).groupBy("query_key").agg(
        F.count("*").alias("n_saved"), F.min("query_id").alias("first_query")
    )


def _map(mapping: dict, key: str) -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in mapping.items())
    return f"try_element_at(map({pairs}), {key})"


def _value_text(v: str) -> str:
    """Display text of one value ``v`` of filter ``f``."""
    numbers = _in([k for k, kind in FIELDS.items() if kind in ("int", "float")])
    # Whole numbers as they are; others with at most two decimals, half up.
    rounded = f"CAST(floor(CAST({v} AS DOUBLE) * 100D + 0.5D) / 100D AS DECIMAL(38, 2))"
    plain = (
        f"CASE WHEN {v} RLIKE '^-?[0-9]+$' THEN CAST(CAST({v} AS DECIMAL(38, 0)) AS STRING)"
        f" ELSE regexp_replace(CAST({rounded} AS STRING), '[.]?0+$', '') END"
    )
    number = f"concat({plain}, coalesce({_map(UNITS, 'f.field')}, ''))"
    third = _map(THIRD_TEXT, f"regexp_replace({v}, '_[a-z]+$', '')")
    zone = f"concat(substring_index({v}, '_', -1), ' ', coalesce({third}, ''))"
    return (
        f"CASE WHEN f.field IN {numbers} THEN {number}"
        f" WHEN f.field IN ('start_zone', 'end_zone') THEN {zone}"
        f" WHEN f.field IN ('start_type', 'outcome') THEN coalesce({_map(VALUE_TEXT, v)}, {v})"
        f" ELSE {v} END"
    )


def describe_filters() -> Column:
    """array<string>: one phrase per filter.

    A complete third or channel is named once; more than three values are counted.
    """
    label = _map(FIELD_LABELS, "f.field")
    first, second = _value_text("f.values[0]"), _value_text("try_element_at(f.values, 2)")
    zoned = "f.field IN ('start_zone', 'end_zone')"
    # Whole thirds and channels are taken in this order, each removing its zones.
    groups = [([f"{t}_{c}" for c in K.CHANNELS], f"the {THIRD_TEXT[t]}") for t in K.THIRDS]
    groups += [([f"{t}_{c}" for t in K.THIRDS], f"the {c} channel") for c in K.CHANNELS]
    state = f"named_struct('rest', f.values, 'said', CAST(array() AS array<string>))"
    whole = f"array({', '.join('named_struct(' + repr('z') + ', array' + _in(z) + ', ' + repr('t') + ', ' + repr(t) + ')' for z, t in groups)})"
    taken = (
        f"aggregate({whole}, {state}, (acc, g) ->"
        f" CASE WHEN {zoned} AND size(array_intersect(acc.rest, g.z)) = 3 THEN"
        " named_struct('rest', filter(acc.rest, z -> NOT array_contains(g.z, z)), 'said', concat(acc.said, array(g.t)))"
        " ELSE acc END, acc ->"
        f" concat(acc.said, transform(acc.rest, v -> {_value_text('v')})))"
    )
    listing = (
        f"transform(array({taken}), s -> CASE WHEN size(s) <= 3 THEN array_join(s, ' or ')"
        " ELSE concat(array_join(slice(s, 1, 2), ', '), ' +', size(s) - 2, ' more') END)[0]"
    )
    flags = _in([k for k, kind in FIELDS.items() if kind == "bool"])
    on = "((f.op = 'eq') = (f.values[0] = 'true'))"
    return F.expr(
        f"transform(filters, f -> CASE WHEN f.field IN {flags} THEN"
        f" CASE WHEN {on} THEN {label} ELSE concat('not ', lower({label})) END"
        f" WHEN f.op = 'eq' THEN concat({label}, ' is ', {first})"
        f" WHEN f.op = 'neq' THEN concat({label}, ' is not ', {first})"
        f" WHEN f.op = 'gte' THEN concat({label}, ' ≥ ', {first})"
        f" WHEN f.op = 'lte' THEN concat({label}, ' ≤ ', {first})"
        f" WHEN f.op = 'in' THEN concat({label}, ': ', {listing})"
        f" WHEN f.op = 'between' THEN concat({label}, ' ', {first}, '–', {second})"
        f" ELSE concat({label}, ' ', f.op) END)"
    )


def describe_order() -> Column:
    label = _map(FIELD_LABELS, "order_field")
    return F.expr(
        "CASE WHEN order_field IS NULL THEN 'best chance first' ELSE"
        f" concat({label}, CASE WHEN order_dir = 'desc' THEN ' high → low' ELSE ' low → high' END)"
        " END"
    )


def describe(saved: DataFrame) -> DataFrame:
    return saved.withColumns({"phrases": describe_filters(), "order_text": describe_order()})


# Validation of many queries: the rules of ``search.check_query`` as columns ----------------------

_NUMBER = r"^-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?$"


def _lookup(pairs: Mapping[str, Column], key: Column) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])[key]


def filter_error(f: Column, place: Column, enums: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Path of the first fault of one filter, null for a valid one."""
    known = {**ENUM_VALUES, **(enums or {})}
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    kind = _lookup({k: F.lit(v) for k, v in FIELDS.items()}, f["field"])
    ops = _lookup({k: strings(allowed_ops(k)) for k in FIELDS}, f["field"])
    words = _lookup({k: strings(v) for k, v in known.items()}, f["field"])
    wanted = F.when(f["op"] == "in", F.size(f["values"]) > 0).when(f["op"] == "between", F.size(f["values"]) == 2).otherwise(F.size(f["values"]) == 1)

    def fits(v: Column) -> Column:
        number = F.when(v.rlike(_NUMBER), v.try_cast("double"))
        return F.coalesce(
            F.when(kind == "bool", v.isin("true", "false")).when(kind == "int", v.rlike("^-?[0-9]+$"))
            .when(kind == "float", number.isNotNull() & (F.abs(number) < F.lit(float("inf"))))
            .when(kind == "enum", F.array_contains(words, v)).otherwise(v.isNotNull()),
            F.lit(False),
        )

    low, high = (F.get(f["values"], i).try_cast("double") for i in (0, 1))
    path = F.concat(F.lit("filters["), place.cast("string"), F.lit("]"))
    return (
        F.when(kind.isNull(), F.concat(path, F.lit(".field")))
        .when(~F.coalesce(F.array_contains(ops, f["op"]), F.lit(False)), F.concat(path, F.lit(".op")))
        .when(f["values"].isNull() | ~wanted | F.exists(f["values"], lambda v: ~fits(v)), F.concat(path, F.lit(".value")))
        .when((f["op"] == "between") & (low > high), F.concat(path, F.lit(".value")))
    )


def query_errors(saved: DataFrame, enums: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """All columns of ``saved`` and ``error``: the path of the first fault, filters in order before the
    ordering, or null where the language accepts the query."""
    faults = F.transform("filters", lambda f, i: filter_error(f, i, enums))
    numeric = F.col("order_field").isin(*[k for k in FIELDS if is_numeric(k)])
    order = (
        F.when(F.col("order_field").isNull() & F.col("order_dir").isNull(), None)
        .when(F.col("order_field").isNull() | ~numeric, F.lit("order_by.field"))
        .when(~F.coalesce("order_dir", F.lit("desc")).isin("asc", "desc"), F.lit("order_by.dir"))
    )
    first = F.get(F.filter(faults, lambda e: e.isNotNull()), 0)
    return saved.withColumn("error", F.coalesce(first, order))
