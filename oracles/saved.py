"""DuckDB twins of the saved-query jobs."""

from __future__ import annotations

from oracles import base as B
from phasegrid.catalog import TRIED_OPS, TRIED_VALUES
from phasegrid.operators.search import ENUM_VALUES, FIELDS
from phasegrid.sources.testdata import COMPETITIONS

_SAVED = """
saved AS (
  SELECT phase_id AS query_id, seq, CASE WHEN seq % 3 = 0 THEN 'xg' END AS order_field,
    CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN 'asc' ELSE 'desc' END END AS order_dir, [
    {'k': 0, 'field': 'counterattack', 'op': CASE WHEN seq % 2 = 0 THEN 'eq' ELSE 'neq' END, 'v': [CASE WHEN seq % 3 = 0 THEN 'true' ELSE 'false' END]},
    {'k': 1, 'field': 'start_zone', 'op': 'in', 'v': CASE seq % 4 WHEN 0 THEN ['def_third_left', 'def_third_centre', 'def_third_right']
      WHEN 1 THEN ['mid_third_left'] WHEN 2 THEN ['def_third_left', 'mid_third_left', 'final_third_left', 'final_third_centre']
      ELSE ['def_third_left', 'mid_third_centre', 'final_third_right', 'mid_third_right'] END},
    {'k': 2, 'field': 'n_passes', 'op': 'gte', 'v': [n_passes::VARCHAR]},
    {'k': 3, 'field': 'n_passes', 'op': 'lte', 'v': [(n_passes + 3) || '.5']},
    {'k': 4, 'field': 'period', 'op': 'eq', 'v': [period::VARCHAR]},
    {'k': 5, 'field': 'duration_s', 'op': CASE WHEN seq % 5 = 0 THEN 'between' ELSE 'gte' END, 'v': CASE WHEN seq % 5 = 0 THEN ['2.25', '30.0'] ELSE ['7.125'] END},
    {'k': 6, 'field': 'outcome', 'op': 'eq', 'v': [outcome]},
    {'k': 7, 'field': 'team_name', 'op': 'neq', 'v': ['Team 3']},
    {'k': 8, 'field': 'match_id', 'op': 'eq', 'v': [(38693780 + seq % 2)::VARCHAR]},
    {'k': 9, 'field': 'team_name', 'op': 'in', 'v': CASE WHEN seq % 2 = 0 THEN ['A,B', 'C'] ELSE ['A', 'B,C'] END},
    {'k': 10, 'field': 'end_zone', 'op': 'in', 'v': ['mid_third_left', 'def_third_right', 'def_third_right']}] AS fs
  FROM phases
), flt AS (SELECT query_id, order_field, order_dir, f.k, f.field, f.op, f.v FROM (SELECT *, unnest(fs) AS f FROM saved))"""
_RANGES = ["duration_s", "n_passes", "progression_m", "xg", "pressure_events", "direct_speed_m_s", "minute"]
_ENUMS = ["outcome", "start_type", "start_zone", "end_zone", "competition", "team_name"]
_BOOLS = ["high_press_regain", "counterattack", "switch_of_play", "reached_final_third", "reached_box", "has_360"]
_INTS = "('n_passes', 'pressure_events', 'minute')"


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_CANON = f"""
bounds AS (
  SELECT query_id, field, last(v[1] ORDER BY k) FILTER (op IN ('gte', 'between')) AS low, last(v[-1] ORDER BY k) FILTER (op IN ('lte', 'between')) AS high
  FROM flt WHERE list_contains({_list(_RANGES)}, field) AND op IN ('gte', 'lte', 'between') GROUP BY 1, 2
), fixed AS (
  SELECT query_id, field, CASE WHEN field IN {_INTS} THEN floor(low::DOUBLE + 0.5)::BIGINT::VARCHAR ELSE low END AS low,
    CASE WHEN field IN {_INTS} THEN floor(high::DOUBLE + 0.5)::BIGINT::VARCHAR ELSE high END AS high FROM bounds
), parts AS (
  SELECT query_id, 0 AS c, k AS o, field, op, v FROM flt
  WHERE NOT ((list_contains({_list(_BOOLS)}, field) AND op IN ('eq', 'neq')) OR (list_contains({_list(_ENUMS)}, field) AND op IN ('eq', 'in'))
    OR (list_contains({_list(_RANGES)}, field) AND op IN ('gte', 'lte', 'between')))
  UNION ALL
  SELECT query_id, 1, list_position({_list(_BOOLS)}, field), field, 'eq', [last(CASE WHEN (op = 'eq') = (v[1] = 'true') THEN 'true' ELSE 'false' END ORDER BY k)]
  FROM flt WHERE list_contains({_list(_BOOLS)}, field) AND op IN ('eq', 'neq') GROUP BY query_id, field
  UNION ALL
  SELECT query_id, 2, list_position({_list(_ENUMS)}, field), field, CASE WHEN len(v) = 1 THEN 'eq' ELSE 'in' END, v
  FROM (SELECT query_id, field, last(v ORDER BY k) AS v FROM flt WHERE list_contains({_list(_ENUMS)}, field) AND op IN ('eq', 'in') GROUP BY 1, 2)
  UNION ALL
  SELECT query_id, 3, list_position({_list(_RANGES)}, field), field, CASE WHEN low IS NULL THEN 'lte' WHEN high IS NULL THEN 'gte' ELSE 'between' END,
    list_filter([low, high], lambda x: x IS NOT NULL) FROM fixed
), canon AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c, o) - 1 AS "at", field, op, v FROM parts)"""


def canonical_sql() -> str:
    return B.on("phases", "SELECT query_id, \"at\", field, op, array_to_string(v, ',') AS values FROM canon", _SAVED, _CANON)


def groups_sql() -> str:
    return B.on("phases", """
SELECT sha256(to_json({'f': k, 'o': o})::VARCHAR) AS query_key, count(*) AS n_saved, min(query_id) AS first_query FROM (
  SELECT c.query_id, list_sort(list(field || '|' || op || '|' || to_json(v)::VARCHAR)) AS k, any_value(coalesce(order_field || '|' || order_dir, '')) AS o
  FROM canon c JOIN saved s ON c.query_id = s.query_id GROUP BY 1) GROUP BY k, o""", _SAVED, _CANON)


_THIRD = "CASE split_part({v}, '_', 1) WHEN 'def' THEN 'defensive third' WHEN 'mid' THEN 'middle third' ELSE 'final third' END"
_ZTEXT = "split_part({v}, '_', 3) || ' ' || " + _THIRD
_OUT = (
    "CASE v[1] WHEN 'shot_on_target' THEN 'shot on target' WHEN 'shot_off_target' THEN 'shot off target' WHEN 'lost_ball' THEN 'lost the ball'"
    " WHEN 'out_of_play' THEN 'out of play' WHEN 'foul_won' THEN 'foul won' WHEN 'end_of_period' THEN 'end of period' ELSE v[1] END"
)


def phrases_sql() -> str:
    zones = f"list_transform(v, lambda z: {_ZTEXT.format(v='z')})"
    rest = f"list_transform(list_filter(v, lambda z: NOT ends_with(z, '_left')), lambda z: {_ZTEXT.format(v='z')})"
    said = (
        f"CASE seq % 4 WHEN 0 THEN ['the defensive third'] WHEN 2 THEN list_concat(['the left channel'], {rest}) ELSE {zones} END"
    )
    return B.on("phases", f"""
SELECT query_id, string_agg(phrase, ' / ' ORDER BY k) AS phrases, any_value(order_text) AS order_text FROM (
  SELECT f.query_id, k, CASE WHEN f.order_field IS NULL THEN 'best chance first' ELSE 'xG ' || CASE f.order_dir WHEN 'desc' THEN 'high → low' ELSE 'low → high' END END AS order_text,
    CASE k WHEN 0 THEN CASE WHEN (op = 'eq') = (v[1] = 'true') THEN 'Counterattack' ELSE 'not counterattack' END
      WHEN 1 THEN 'Start zone: ' || CASE WHEN len({said}) <= 3 THEN array_to_string({said}, ' or ')
        ELSE array_to_string(({said})[1:2], ', ') || ' +' || (len({said}) - 2) || ' more' END
      WHEN 2 THEN 'Passes ≥ ' || v[1] WHEN 3 THEN 'Passes ≤ ' || v[1] WHEN 4 THEN 'Period is ' || v[1]
      WHEN 5 THEN CASE op WHEN 'between' THEN 'Duration 2.25s–30s' ELSE 'Duration ≥ 7.13s' END
      WHEN 6 THEN 'Outcome is ' || {_OUT} WHEN 8 THEN 'Match id is ' || v[1] WHEN 9 THEN 'Team: ' || array_to_string(v, ' or ')
      WHEN 10 THEN 'End zone: left middle third or right defensive third or right defensive third' ELSE 'Team is not Team 3' END AS phrase
  FROM flt f JOIN saved s ON f.query_id = s.query_id) GROUP BY 1""", _SAVED)


def errors_sql() -> str:
    """First fault by rule tables: one row a field with its kind, and one a word of a closed list."""
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    names = [*FIELDS, "nothing"]
    values = ", ".join("NULL" if v is None else "[" + ", ".join(map(q, v)) + "]::VARCHAR[]" for v in TRIED_VALUES)
    rules = ", ".join(f"('{f}', '{kind}')" for f, kind in FIELDS.items())
    words = ", ".join(f"('{f}', {q(w)})" for f, ws in {**ENUM_VALUES, "competition": COMPETITIONS}.items() for w in ws)
    return B.on("phases", """
SELECT query_id, CASE
  WHEN kind IS NULL THEN 'filters[1].field'
  WHEN op = 'like' OR (op IN ('gte', 'lte', 'between') AND kind NOT IN ('int', 'float')) OR (op = 'in' AND kind = 'bool')
    OR (op = 'neq' AND field = 'competition') THEN 'filters[1].op'
  WHEN v IS NULL OR len(v) < 1 OR (op = 'between' AND len(v) <> 2) OR (op NOT IN ('in', 'between') AND len(v) <> 1) OR bad > 0
    OR (op = 'between' AND v[1]::DOUBLE > v[2]::DOUBLE) THEN 'filters[1].value'
  WHEN order_field IS NULL AND order_dir IS NOT NULL OR order_field NOT IN ('xg', 'minute') THEN 'order_by.field'
  WHEN order_dir NOT IN ('asc', 'desc') THEN 'order_by.dir' END AS error
FROM judged""", f"""
tried AS (
  SELECT phase_id AS query_id, [{', '.join(map(q, names))}][(seq % {len(names)} + 1)::INT] AS field,
    [{', '.join(map(q, TRIED_OPS))}][((seq // 3) % {len(TRIED_OPS)} + 1)::INT] AS op,
    [{values}][((seq // 2 + match_id) % {len(TRIED_VALUES)} + 1)::INT] AS v,
    [NULL, 'xg', 'outcome', 'minute', NULL][(seq % 5 + 1)::INT] AS order_field,
    [NULL, 'asc', 'down', NULL, 'desc', 'desc'][(seq % 6 + 1)::INT] AS order_dir
  FROM phases
), rules(field, kind) AS (VALUES {rules}), words(field, word) AS (VALUES {words}
), items AS (
  SELECT query_id, field, kind, unnest(v) AS item FROM tried JOIN rules USING (field)
), faults AS (
  SELECT query_id, count(*) FILTER (CASE
    WHEN item IS NULL THEN true
    WHEN kind = 'bool' THEN item NOT IN ('true', 'false')
    WHEN kind = 'int' THEN NOT regexp_full_match(item, '-?[0-9]+')
    WHEN kind = 'float' THEN NOT regexp_full_match(item, '-?[0-9]+([.][0-9]+)?') -- no finite exponent is tried
    WHEN kind = 'enum' THEN word IS NULL ELSE false END) AS bad
  FROM items LEFT JOIN words ON words.field = items.field AND word = item GROUP BY 1
), judged AS (
  SELECT t.*, kind, coalesce(bad, 0) AS bad FROM tried t LEFT JOIN rules USING (field) LEFT JOIN faults USING (query_id)
)""")
