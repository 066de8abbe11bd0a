"""The closed filter / order / limit language over the phase table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid import constants as K
from phasegrid.functions.scan import by_shuffle

VERSION = 1
LIMIT_MIN, LIMIT_MAX, LIMIT_DEFAULT = 1, 96, 48

# Searchable columns and their kinds.
FIELDS: dict[str, str] = {
    "phase_id": "text", "match_id": "int", "possession": "int", "team_id": "int",
    "team_name": "text", "period": "int", "start_ts": "float", "end_ts": "float",
    "minute": "int", "competition": "enum", "start_zone": "enum", "end_zone": "enum",
    "duration_s": "float", "n_passes": "int", "n_events": "int", "n_players": "int",
    "start_type": "enum", "outcome": "enum", "progression_m": "float",
    "direct_speed_m_s": "float", "pressure_events": "int", "high_press_regain": "bool",
    "counterattack": "bool", "switch_of_play": "bool", "reached_final_third": "bool",
    "reached_box": "bool", "xg": "float", "has_360": "bool", "frame_coverage": "float",
}
_ORDERED = ("eq", "neq", "in", "gte", "lte", "between")
OPS_BY_KIND = {
    "int": _ORDERED, "float": _ORDERED, "bool": ("eq", "neq"), "enum": ("eq", "neq", "in"),
    "text": ("eq", "neq", "in"),
}
OPS_BY_FIELD = {"competition": ("eq", "in")}
ENUM_VALUES = {
    "competition": K.COMPETITIONS, "start_zone": K.ZONES, "end_zone": K.ZONES,
    "start_type": K.START_TYPES, "outcome": K.OUTCOMES,
}
# Columns of a search result.
RESULT_COLUMNS = (
    "phase_id", "match_id", "competition", "match_label", "team_name", "opponent_name", "period",
    "minute", "second", "duration_s", "n_events", "n_passes", "n_players", "n_shots",
    "start_type", "outcome", "start_zone", "end_zone", "progression_m", "direct_speed_m_s",
    "pressure_events", "high_press_regain", "counterattack", "switch_of_play",
    "reached_final_third", "reached_box", "xg", "goal_conceded", "has_360", "frame_coverage",
    "path_xy",
)


class QueryError(ValueError):
    """A query the language does not allow; ``path`` says where."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}")
        self.path = path


def is_numeric(field: str) -> bool:
    return FIELDS.get(field) in ("int", "float")


def allowed_ops(field: str) -> tuple[str, ...]:
    return OPS_BY_FIELD.get(field) or OPS_BY_KIND[FIELDS[field]]


def _check_keys(obj: Mapping, allowed: Sequence[str], path: str) -> None:
    if not isinstance(obj, Mapping):
        raise QueryError(path, "must be an object")
    for key in obj:
        if key not in allowed:
            raise QueryError(f"{path}.{key}", "unknown key")


def _check_value(field: str, value, path: str, enums: Mapping[str, Sequence[str]]) -> None:
    kind = FIELDS[field]
    wanted = {"bool": bool, "int": int, "float": (int, float), "enum": str, "text": str}[kind]
    # bool is an int in Python; it never stands for a number here.
    if isinstance(value, bool) != (kind == "bool") or not isinstance(value, wanted):
        raise QueryError(path, f"{field} takes {kind} values, got {value!r}")
    if kind == "float" and (value != value or value in (float("inf"), float("-inf"))):
        raise QueryError(path, f"{field} takes finite numbers")
    if kind == "enum" and value not in enums[field]:
        raise QueryError(path, f"{field} knows no {value!r}")


def check_filter(f: Mapping, path: str = "filter", enums=None) -> None:
    enums = {**ENUM_VALUES, **(enums or {})}
    _check_keys(f, ("field", "op", "value"), path)
    field, op = f.get("field"), f.get("op")
    if field not in FIELDS:
        raise QueryError(f"{path}.field", f"unknown field {field!r}")
    if op not in _ORDERED:
        raise QueryError(f"{path}.op", f"unknown op {op!r}")
    if op not in allowed_ops(field):
        raise QueryError(f"{path}.op", f"{field} cannot be compared by {op!r}")
    if "value" not in f:
        raise QueryError(f"{path}.value", "missing")
    value = f["value"]
    many = isinstance(value, (list, tuple))
    if op == "in" and not (many and value):
        raise QueryError(f"{path}.value", "'in' needs a non-empty list of values")
    if op == "between" and not (many and len(value) == 2):
        raise QueryError(f"{path}.value", "'between' needs two values")
    if op not in ("in", "between") and many:
        raise QueryError(f"{path}.value", f"{op!r} needs a single value")
    for item in value if many else [value]:
        _check_value(field, item, f"{path}.value", enums)
    if op == "between" and value[0] > value[1]:
        raise QueryError(f"{path}.value", "'between' needs low <= high")


def check_query(query: Mapping, enums=None) -> dict:
    """Validate and fill defaults.  Limits outside 1..96 are clamped, everything else is strict."""
    _check_keys(query, ("version", "filters", "order_by", "limit"), "query")
    if query.get("version", VERSION) != VERSION or isinstance(query.get("version"), bool):
        raise QueryError("query.version", f"must be {VERSION}")
    filters = list(query.get("filters", ()))
    for i, f in enumerate(filters):
        check_filter(f, f"filters[{i}]", enums)
    order = query.get("order_by")
    if order is not None:
        _check_keys(order, ("field", "dir"), "order_by")
        if not is_numeric(order.get("field")):
            raise QueryError("order_by.field", "must name a numeric field")
        if order.get("dir", "desc") not in ("asc", "desc"):
            raise QueryError("order_by.dir", "must be 'asc' or 'desc'")
        order = {"field": order["field"], "dir": order.get("dir", "desc")}
    limit = query.get("limit", LIMIT_DEFAULT)
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise QueryError("query.limit", "must be an integer")
    return {
        "version": VERSION,
        "filters": filters,
        "order_by": order,
        "limit": min(max(limit, LIMIT_MIN), LIMIT_MAX),
    }


def filter_column(f: Mapping, schema) -> Column:
    """One filter as a predicate.  Literals take the column's own type, so they reach the scan."""
    column = F.col(f["field"])
    kind = schema[f["field"]].dataType

    def lit(v) -> Column:
        return F.lit(v).cast(kind)

    op, value = f["op"], f["value"]
    if isinstance(kind, T.IntegralType):
        settled = _beyond(column, op, value, 1 << (8 * _BYTES[kind.typeName()] - 1))
        if settled is not None:
            return settled
    if op == "in":
        return column.isin(*[lit(v) for v in value])
    if op == "between":
        return column.between(lit(value[0]), lit(value[1]))
    compare = {"eq": "__eq__", "neq": "__ne__", "gte": "__ge__", "lte": "__le__"}[op]
    return getattr(column, compare)(lit(value))


# Bytes of Spark's integer types.
_BYTES = {"byte": 1, "short": 2, "integer": 4, "long": 8}


def _beyond(column: Column, op: str, value, limit: int) -> Column | None:
    """The predicate where a literal lies outside the column's type, else None.

    Such a literal cannot be cast, but the answer is known: the column is below (or above) it.
    """
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if all(-limit <= v < limit for v in values):
        return None
    always, never = column.isNotNull(), column.isNotNull() & F.lit(False)
    if op == "in":
        inside = [v for v in values if -limit <= v < limit]
        return column.isin(*inside) if inside else never
    if op == "between":
        low, high = max(values[0], -limit), min(values[1], limit - 1)
        return column.between(low, high) if low <= high else never
    if op in ("eq", "neq"):
        return always if op == "neq" else never
    return always if (values[0] < 0) == (op == "gte") else never


def predicate(query: Mapping, schema, extra: Sequence[Column] = ()) -> Column:
    """Conjunction of all filters; no filter keeps every row."""
    terms = [filter_column(f, schema) for f in query["filters"]] + list(extra)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def ordering(order_by: Mapping | None) -> list[Column]:
    if order_by is None:
        return [F.desc("xg"), F.desc("progression_m"), F.asc("phase_id")]
    key = F.asc if order_by["dir"] == "asc" else F.desc
    return [key(order_by["field"]), F.asc("phase_id")]


def search(
    phases: DataFrame,
    query: Mapping,
    columns: Sequence[str] = RESULT_COLUMNS,
    extra: Sequence[Column] = (),
    enums=None,
) -> DataFrame:
    """Filter, order, limit: a pushed-down scan and one top-k."""
    q = check_query(query, enums)
    return (
        phases.filter(predicate(q, phases.schema, extra))
        .orderBy(*ordering(q["order_by"]))
        .limit(q["limit"])
        .select(*columns)
    )


def count_matches(phases: DataFrame, query: Mapping, extra: Sequence[Column] = (), enums=None) -> DataFrame:
    q = check_query(query, enums)
    return phases.filter(predicate(q, phases.schema, extra)).agg(F.count("*").alias("n"))


def phase_by_id(phases: DataFrame, phase_id: str) -> DataFrame:
    return search(
        phases,
        {"filters": [{"field": "phase_id", "op": "eq", "value": phase_id}], "limit": 1},
    )


def vocabulary(phases: DataFrame, column: str) -> DataFrame:
    return phases.select(column).distinct().orderBy(column)


def search_vocabulary(values: DataFrame, column: str, text: str, selected: Sequence[str] = ()) -> DataFrame:
    """Values that contain ``text`` in any case, plus the ones already selected."""
    hit = F.lower(column).contains(text.strip().lower())
    if selected:
        hit = hit | F.col(column).isin(*selected)
    return values.filter(hit)


def search_many(
    phases: DataFrame, queries: Mapping[str, Mapping], top: int | None = None, enums=None
) -> DataFrame:
    """Run many saved queries in one scan: matches ranked per query, with the match count.

    A row is emitted once per query it satisfies.  ``row_number() <= limit`` lets Spark cut every
    query's group to its limit before the shuffle, so a query that matches most of the table stays
    small; the counts come from one aggregate over the same rows.
    """
    checked = {name: check_query(q, enums) for name, q in queries.items()}
    hits = []
    for name, q in checked.items():
        keys = ordering_keys(q["order_by"])
        limit = min(q["limit"], top) if top else q["limit"]
        hits.append(
            F.when(
                predicate(q, phases.schema),
                F.struct(
                    F.lit(name).alias("query"), F.lit(limit).alias("cut"), keys[0].alias("k1"),
                    keys[1].alias("k2"),
                ),
            )
        )
    found = phases.select(
        "phase_id", F.explode(F.array_compact(F.array(*hits))).alias("h")
    ).select("phase_id", "h.*")
    counts = found.groupBy("query").agg(F.count("*").alias("n_matches"))
    w = Window.partitionBy("query").orderBy("k1", "k2", "phase_id")
    most = max(min(q["limit"], top) if top else q["limit"] for q in checked.values())
    ranked = (
        found.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= most)
        .filter(F.col("rank") <= F.col("cut"))
    )
    return ranked.join(counts, "query").select("query", "rank", "phase_id", "n_matches")


def ordering_keys(order_by: Mapping | None) -> tuple[Column, Column]:
    """Ascending sort keys equal to ``ordering``."""
    if order_by is None:
        return -F.col("xg").cast("double"), -F.col("progression_m").cast("double")
    key = F.col(order_by["field"]).cast("double")
    return (key if order_by["dir"] == "asc" else -key), F.lit(0.0)


# Pinned phases of reports -------------------------------------------------------------------


def pinned_ids(sections: DataFrame) -> DataFrame:
    """Distinct pinned ids in document order (first appearance wins)."""
    place = F.min(F.struct("section", "ordinal"))
    return (
        sections.groupBy("phase_id")
        .agg(place.alias("_p"))
        .select("phase_id", F.col("_p.section").alias("section"), F.col("_p.ordinal").alias("ordinal"))
    )


def pinned_phases(phases: DataFrame, sections: DataFrame, columns=RESULT_COLUMNS) -> DataFrame:
    """Pinned phases that exist, in document order."""
    return (
        pinned_ids(sections)
        .join(by_shuffle(phases.select(*columns)), "phase_id")
        .orderBy("section", "ordinal", "phase_id")
    )


def missing_pins(phases: DataFrame, sections: DataFrame) -> DataFrame:
    return pinned_ids(sections).join(by_shuffle(phases.select("phase_id")), "phase_id", "left_anti")


def summarize(phases: DataFrame, ids: DataFrame) -> DataFrame:
    """The summary strip over a set of pinned ids; an empty set gives zero counts and NULL means."""
    chosen = phases.join(by_shuffle(ids.select("phase_id").distinct()), "phase_id", "left_semi")
    return chosen.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("outcome") == "goal").alias("goals"),
        F.count_if(F.col("n_shots") > 0).alias("shots"),
        F.count_distinct("match_id").alias("matches"),
        F.count_distinct("team_name").alias("teams"),
        F.avg("duration_s").alias("avg_duration_s"),
        F.avg(F.when(F.col("xg") > 0, F.col("xg"))).alias("avg_xg"),
        F.count_if(F.col("xg") > 0).alias("n_with_xg"),
    )


# The five ready-made searches.
def _preset(order: str, *filters) -> dict:
    return {
        "version": VERSION,
        "filters": [{"field": f, "op": o, "value": v} for f, o, v in filters]
        + [{"field": "duration_s", "op": "gte", "value": 2}],
        "order_by": {"field": order, "dir": "desc"},
        "limit": LIMIT_DEFAULT,
    }


PRESETS = {
    "high-turnover-shot": _preset(
        "xg", ("high_press_regain", "eq", True), ("outcome", "in", list(K.SHOT_OUTCOMES))
    ),
    "counter-box": _preset(
        "direct_speed_m_s", ("counterattack", "eq", True), ("reached_box", "eq", True)
    ),
    "goal-kick-final-third": _preset(
        "n_passes", ("start_type", "eq", "goal_kick"), ("reached_final_third", "eq", True)
    ),
    "switch-shot": _preset(
        "xg", ("switch_of_play", "eq", True), ("outcome", "in", list(K.SHOT_OUTCOMES))
    ),
    "highest-xg": _preset("xg", ("xg", "gte", 0.1)),
}
