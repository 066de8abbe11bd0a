"""DuckDB twins of the request parser."""

from __future__ import annotations

from oracles import base as B

_TEXT = """
CASE seq % 7
 WHEN 0 THEN 'Top ' || (1 + seq % 120) || ' fastest counterattacks by ' || team_name || ' against ' || opponent_name
 WHEN 1 THEN 'High turnovers leading to a shot under ' || (5 + seq % 20) || ' seconds'
 WHEN 2 THEN 'the best chances of ' || team_name || ' from corners with at least ' || (seq % 9) || ' passes'
 WHEN 3 THEN 'Long patient build-up starting wide in the middle third, ' || team_name || ' 2024'
 WHEN 4 THEN 'Goals from a free kick by Cristiano Ronaldo in the final'
 WHEN 5 THEN 'quick  switches starting centrally in the defensive third over ' || (2 + seq % 9) || '.5 seconds while pressed'
 ELSE replace(outcome, '_', ' ') || ' after a ' || replace(start_type, '_', ' ') || ' that reached the final third – ' || team_name || ' vs ' || opponent_name
END"""
_LOG = f"log AS (SELECT phase_id AS request_id, {_TEXT} AS text FROM phases)"
_TURNS = "log AS (SELECT conv_id || '-' || turn AS request_id, text FROM conversations)"


def has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def number(*cues: str) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract(t, '{c}\\s+([0-9]+(?:\\.[0-9]+)?)', 1), '')" for c in cues) + ")"


_BASE = f"""
norm AS (
  SELECT request_id, trim(text) AS raw,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[‐-―]', '-', 'g'), '[‘’]', '''', 'g'), '[\\s\\x0B\\x{{00A0}}]+', ' ', 'g')) AS t FROM log
), facts AS MATERIALIZED (
  SELECT *, {number('under', 'less than', 'shorter than', 'within', 'inside')} AS under_s,
    {number('over', 'more than', 'longer than', 'at least', 'above')} AS over_s,
    coalesce({number('at least', 'minimum of', 'more than')}, nullif(regexp_extract(t, '([0-9]+)\\s*\\+\\s*pass', 1), '')) AS passes,
    {number('top', 'first', 'show me', 'give me')} AS top_n,
    nullif(regexp_extract(t, '\\b(?:start(?:ing|s|ed)?|beginning|begin|originating|from)\\b[^.]{{0,24}}?\\b(defensive|own|middle|final|attacking)\\b[^.]{{0,12}}?third', 1), '') AS zone_word,
    {has('high turnover', 'high press', 'high-press', 'won it high', 'winning it high', 'high regain', 'press high')} AS high,
    regexp_matches(t, '(^|[^a-z])goals?([^a-z]|$)') AND NOT {has('goal kick', 'goal-kick')} AS goal,
    {has('long possession', 'sustained', 'patient', 'long build-up', 'long buildup')} AS long,
    nullif(regexp_extract(raw, '\\b(?:by|from|for)\\s+([A-Z][a-zà-ÿ''’-]+(?:\\s+[A-Z][a-zà-ÿ''’-]+)+)', 1), '') AS person,
    regexp_replace(t, '\\b(against|vs|versus)\\b.*$', '') AS space
  FROM norm
), names AS (SELECT DISTINCT team_name, lower(team_name) AS k FROM phases
), team AS (
  SELECT request_id, team_name FROM (
    SELECT request_id, team_name, row_number() OVER (PARTITION BY request_id ORDER BY strpos(space, k), length(k) DESC, team_name) AS r
    FROM facts JOIN names ON contains(space, k) AND regexp_matches(space, '(^|[^a-z])' || regexp_escape(k) || '([^a-z]|$)')) WHERE r = 1
)"""
_ZONE3 = "CASE WHEN zone_word IN ('defensive', 'own') THEN 'def_third' WHEN zone_word = 'middle' THEN 'mid_third' ELSE 'final_third' END"
_SHOTS = "goal,shot_on_target,shot_off_target"


def _row(field: str, op: str, value: str, cond: str) -> str:
    return f"SELECT request_id, '{field}' AS field, '{op}' AS op, {value} AS values FROM facts WHERE {cond}"


_WIDE, _CENTRAL = has("wide", "from the flank", "out wide"), has("central", "centrally", "through the middle")
_START = (
    f"CASE WHEN {has('corner')} THEN 'corner' WHEN {has('free kick', 'free-kick', 'freekick')} THEN 'free_kick'"
    f" WHEN {has('throw in', 'throw-in', 'throwin')} THEN 'throw_in'"
    f" WHEN {has('goal kick', 'goal-kick', 'from the back')} THEN 'goal_kick'"
    f" WHEN {has('kick off', 'kick-off', 'kickoff')} THEN 'kick_off'"
    f" WHEN NOT high AND {has('turnover', 'won the ball back', 'regain')} THEN 'turnover_open_play' END"
)
_FILTERS = "found AS MATERIALIZED (" + " UNION ALL ".join([
    _row("high_press_regain", "eq", "'true'", "high"),
    _row("counterattack", "eq", "'true'", has("counter", "on the break", "transition")),
    _row("switch_of_play", "eq", "'true'", has("switch", "changed the point of attack", "change the point of attack")),
    _row("outcome", "eq", "'goal'", "goal"),
    _row("outcome", "in", f"'{_SHOTS}'", f"NOT goal AND {has('shot')}"),
    _row("reached_box", "eq", "'true'", has("box", "penalty area", "eighteen-yard", "18-yard")),
    _row("reached_final_third", "eq", "'true'", has("final third", "attacking third", "last third")
         + " AND NOT regexp_matches(t, '\\b(start(ing|s|ed)?|beginning|begin|from)\\b[^.]{0,20}final third')"),
    _row("duration_s", "gte", f"CASE WHEN over_s IS NOT NULL AND {has('second')} THEN over_s::DOUBLE::VARCHAR ELSE '20.0' END",
         f"long OR (over_s IS NOT NULL AND {has('second')})"),
    _row("n_passes", "gte", f"CASE WHEN passes IS NOT NULL AND {has('pass')} THEN passes::DOUBLE::VARCHAR ELSE '8.0' END",
         f"long OR (passes IS NOT NULL AND {has('pass')})"),
    _row("direct_speed_m_s", "gte", "'3.0'", has("quick", "fast", "direct", "vertical", "rapid")),
    _row("duration_s", "lte", "under_s::DOUBLE::VARCHAR", f"under_s IS NOT NULL AND {has('second')}"),
    _row("start_type", "eq", _START, f"({_START}) IS NOT NULL"),
    _row("xg", "gte", "'0.1'", has("big chance", "good chance", "clear chance", "great chance", "best chances")),
    _row("pressure_events", "gte", "'1.0'", has("under pressure", "pressed", "pressing")),
    _row("has_360", "eq", "'true'", has("360", "freeze frame", "freeze-frame")),
    _row("start_zone", "in",
         f"CASE WHEN {_WIDE} THEN {_ZONE3} || '_left,' || {_ZONE3} || '_right' WHEN {_CENTRAL} THEN {_ZONE3} || '_centre'"
         f" ELSE {_ZONE3} || '_left,' || {_ZONE3} || '_centre,' || {_ZONE3} || '_right' END", "zone_word IS NOT NULL"),
    "SELECT request_id, 'team_name', 'eq', team_name FROM team",
    _row("competition", "eq", f"CASE WHEN {has('2024')} THEN 'Cup A' ELSE 'Cup B' END", has("2024", "2020")),
]) + ")"
_DROPS = (
    ("opponent (the index filters the team in possession only)", "\\bagainst\\b|\\bvs\\b|\\bversus\\b|\\bopponent"),
    ("date or round (not a DSL field)",
     "\\b(19|20)\\d{2}-\\d{2}-\\d{2}\\b|\\bjune\\b|\\bjuly\\b|\\bmatch ?day\\b|\\bthe final\\b|\\bsemi-?final\\b|\\bquarter-?final\\b|\\bgroup stage\\b|\\bround of 16\\b"),
    ("scoreline or game state (not a DSL field)",
     "\\b\\d\\s*-\\s*\\d\\b|\\bscoreline\\b|\\bwinning\\b|\\blosing\\b|\\bdrawing\\b|\\bleading\\b|\\bbehind\\b"),
    ("event-level action (phases are searched by their summary features)",
     "\\bassist|\\bdribble|\\bbeat (two|three|a|the) defender|\\bheader|\\bnutmeg|\\bcross(es|ed)?\\b|\\btackle"),
    ("role (no player or role columns in the index)", "\\bkeeper\\b|\\bgoalkeeper\\b|\\bmanager\\b|\\bcoach\\b"),
)
_DROPPED = (
    "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{rx}') THEN '{label}' END" for label, rx in _DROPS)
    + ", CASE WHEN person IS NOT NULL AND lower(person) NOT IN (SELECT k FROM names) THEN '\"' || person || '\" (no player names in the phase index)' END],"
    " lambda v: v IS NOT NULL)"
)
_ORDER = (
    f"CASE WHEN {has('best', 'highest xg', 'biggest chance', 'highest-xg')} THEN 'xg' WHEN {has('fastest', 'most direct', 'quickest')} THEN 'direct_speed_m_s'"
    f" WHEN {has('longest', 'slowest')} THEN 'duration_s' WHEN {has('most progressive', 'furthest')} THEN 'progression_m' END"
)


def filters_sql() -> str:
    return B.on("phases", "SELECT * FROM found", _LOG, _BASE, _FILTERS)


def orders_sql() -> str:
    return B.on("phases", f"""
SELECT f.request_id, coalesce(n, 0) AS n_filters, {_ORDER} AS order_field, CASE WHEN {_ORDER} IS NOT NULL THEN 'desc' END AS order_dir,
  (CASE WHEN top_n IS NULL THEN 48 ELSE least(greatest(floor(top_n::DOUBLE), 1), 96) END)::BIGINT AS max_rows, array_to_string({_DROPPED}, '; ') AS dropped
FROM facts f LEFT JOIN (SELECT request_id, count(*) AS n FROM found GROUP BY 1) c ON f.request_id = c.request_id""", _LOG, _BASE, _FILTERS)


def conversation_sql() -> str:
    order = ("high_press_regain eq,counterattack eq,switch_of_play eq,outcome eq,outcome in,reached_box eq,reached_final_third eq,duration_s gte,"
             "n_passes gte,direct_speed_m_s gte,duration_s lte,start_type eq,xg gte,pressure_events gte,has_360 eq,start_zone in,team_name eq,competition eq")
    slots = ", ".join(f"'{s}'" for s in order.split(","))
    return B.on("phases", f"""
SELECT f.request_id, coalesce(n, 0) AS n_filters, coalesce(fields, '') AS fields, len({_DROPPED})::BIGINT AS n_dropped
FROM facts f LEFT JOIN (SELECT request_id, count(*) AS n, string_agg(field, ',' ORDER BY list_position([{slots}], field || ' ' || op)) AS fields FROM found GROUP BY 1) c
  ON f.request_id = c.request_id""", _TURNS, _BASE, _FILTERS)
