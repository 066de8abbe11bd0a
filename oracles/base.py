"""Shared SQL of the DuckDB twins: the match-event view and the tables built from it."""

from __future__ import annotations

# Event type names used by the view.
_TYPE_NAMES = {
    2: "Ball Recovery", 3: "Dispossessed", 4: "Duel", 6: "Block", 9: "Clearance",
    10: "Interception", 14: "Dribble", 16: "Shot", 17: "Pressure", 18: "Half Start",
    19: "Substitution", 20: "Own Goal Against", 21: "Foul Won", 22: "Foul Committed",
    23: "Goal Keeper", 30: "Pass", 34: "Half End", 38: "Miscontrol", 42: "Ball Receipt*",
    43: "Carry",
}
_TYPE_CASE = "CASE type_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _TYPE_NAMES.items()) + " END"

EVENTS = f"""
base AS (
  SELECT event_id, 1000 + user_id % 40 AS match_id,
         row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS idx,
         count(*) OVER (PARTITION BY user_id % 40) AS n_match
  FROM events
), clk AS (
  SELECT *, CASE WHEN idx * 20 <= n_match * 9 THEN 1 WHEN idx * 20 <= n_match * 18 THEN 2
                 WHEN idx * 20 <= n_match * 19 THEN 3 WHEN idx * 100 <= n_match * 99 THEN 4 ELSE 5 END AS period
  FROM base
), seqd AS (
  SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY idx) AS pidx,
         count(*) OVER (PARTITION BY match_id, period) AS n_period,
         CASE WHEN (event_id * 7919) % 13 < 3 THEN 1 ELSE 0 END AS brk
  FROM clk
), poss AS (
  SELECT *, 1 + CAST(sum(brk) OVER (PARTITION BY match_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS possession,
         (event_id * 7907) % 100 AS k
  FROM seqd
), typed AS (
  SELECT *, CASE WHEN pidx <= 2 THEN 18 WHEN pidx > n_period - 2 THEN 34
         WHEN k < 30 THEN 30 WHEN k < 46 THEN 42 WHEN k < 60 THEN 43 WHEN k < 72 THEN 17
         WHEN k < 78 THEN 2 WHEN k < 82 THEN 4 WHEN k < 85 THEN 6 WHEN k < 87 THEN 9
         WHEN k < 89 THEN 23 WHEN k < 91 THEN 14 WHEN k < 94 THEN 16 WHEN k < 95 THEN 10
         WHEN k < 96 THEN 38 WHEN k < 97 THEN 21 WHEN k < 98 THEN 22 WHEN k < 99 THEN 19
         ELSE CASE WHEN event_id % 3 = 0 THEN 20 ELSE 3 END END AS type_id,
    CASE WHEN (possession * 31) % 3 < 2 THEN possession % 2 ELSE (possession + 1) % 2 END AS poss_side
  FROM poss
), sided AS (
  SELECT *, CASE WHEN type_id = 17 THEN CASE WHEN event_id % 10 = 0 THEN poss_side ELSE 1 - poss_side END
                 WHEN type_id IN (2, 4, 6, 9, 10, 20, 21, 22, 23) THEN (event_id * 3) % 2
                 ELSE poss_side END AS act_side,
    CASE WHEN type_id IN (18, 34, 19) THEN NULL ELSE CAST(1 + (event_id * 37) % 1200 AS DOUBLE) / CAST(10 AS DOUBLE) END AS x,
    CASE WHEN type_id IN (18, 34, 19) THEN NULL ELSE CAST(1 + (event_id * 53) % 800 AS DOUBLE) / CAST(10 AS DOUBLE) END AS y
  FROM typed
), flat AS (
SELECT match_id, idx AS index, event_id, n_match, match_id || '-' || idx AS event_uuid, period, possession,
  match_id * 10 + poss_side AS possession_team_id, match_id * 10 + act_side AS team_id,
  'Team ' || ((match_id * 3 + act_side * 7) % 29) AS team_name,
  CAST(pidx * 17 AS DOUBLE) / CAST(10 AS DOUBLE) AS ts_s,
  CASE WHEN type_id = 42 THEN NULL ELSE CAST((event_id * 11) % 25 AS DOUBLE) / CAST(10 AS DOUBLE) END AS duration,
  type_id, {_TYPE_CASE} AS type_name,
  CASE WHEN (possession * 13 + match_id) % 20 < 8 THEN 1 WHEN (possession * 13 + match_id) % 20 < 17
       THEN (possession * 13 + match_id) % 20 - 7 ELSE (possession * 13 + match_id) % 20 - 15 END AS play_pattern_id,
  CASE WHEN type_id IN (18, 34) THEN NULL ELSE (match_id * 10 + act_side) * 100 + event_id % 11 END AS player_id,
  x, y,
  CASE WHEN type_id IN (30, 43, 16) THEN CAST(1 + (event_id * 41) % 1200 AS DOUBLE) / CAST(10 AS DOUBLE) END AS end_x,
  CASE WHEN type_id IN (30, 43, 16) THEN CAST(1 + (event_id * 59) % 800 AS DOUBLE) / CAST(10 AS DOUBLE) END AS end_y,
  CASE WHEN type_id = 16 THEN CAST(event_id % 25 AS DOUBLE) / CAST(10 AS DOUBLE) END AS end_z,
  CASE WHEN type_id = 16 THEN 96 + event_id % 6
       WHEN type_id = 30 AND event_id % 5 = 0 THEN CASE event_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 75 WHEN 2 THEN 76 ELSE 77 END
       WHEN type_id = 42 AND event_id % 8 = 0 THEN 9 WHEN type_id = 14 THEN 8 + event_id % 2
       WHEN type_id = 10 THEN CASE WHEN event_id % 2 = 0 THEN 4 ELSE 13 END
       WHEN type_id = 4 THEN CASE WHEN event_id % 3 = 0 THEN 16 ELSE 13 END END AS outcome_id,
  CASE WHEN type_id = 4 THEN 10 + event_id % 2 WHEN type_id = 23 THEN 25 + event_id % 9
       WHEN type_id = 30 AND event_id % 40 = 7 THEN 61 + event_id % 7 END AS sub_type_id,
  CASE WHEN type_id = 16 THEN CAST(1 + (event_id * 67) % 95 AS DOUBLE) / CAST(100 AS DOUBLE) END AS xg,
  event_id % 5 = 0 AS under_pressure, event_id % 7 = 0 AS counterpress, event_id % 23 = 0 AS is_out,
  type_id = 30 AND event_id % 97 = 0 AS pass_switch,
  type_id = 30 AND event_id % 17 = 0 AS "cross", type_id = 30 AND event_id % 29 = 0 AS through_ball,
  type_id = 30 AND event_id % 4 = 1 AS high_pass, type_id = 30 AND event_id % 6 = 2 AS head_pass,
  type_id = 30 AND event_id % 19 = 3 AS aerial_won,
  event_id % 8 <> 0 AS drawn,
  CASE WHEN event_id % 3 = 0 AND idx < n_match THEN match_id || '-' || (idx + 1)
       WHEN event_id % 5 = 0 AND idx > 1 THEN match_id || '-' || (idx - 1) END AS related
FROM sided
), ev AS MATERIALIZED (
  SELECT *, drawn AND x IS NOT NULL AS has_frame,
    CASE period WHEN 1 THEN 0 WHEN 2 THEN 45 WHEN 3 THEN 90 WHEN 4 THEN 105 ELSE 120 END + CAST(floor(ts_s / 60) AS BIGINT) AS minute,
    CAST(floor(ts_s) AS BIGINT) % 60 AS second,
    'Player ' || player_id AS player_name, 'Position ' || (player_id % 11) AS position_name,
    CASE WHEN outcome_id = 97 THEN 'Goal' ELSE 'Outcome ' || outcome_id END AS outcome_name,
    type_id IN (18, 19, 24, 26, 27, 34, 35, 36, 40) AS admin
  FROM flat
), matches AS (
  SELECT DISTINCT match_id, CASE WHEN match_id % 2 = 0 THEN 'Cup A' ELSE 'Cup B' END AS competition,
    match_id * 10 AS home_team_id, 'Team ' || ((match_id * 3) % 29) AS home_team_name,
    match_id * 10 + 1 AS away_team_id, 'Team ' || ((match_id * 3 + 7) % 29) AS away_team_name,
    match_id % 4 AS home_score, match_id % 3 AS away_score,
    'Team ' || ((match_id * 3) % 29) || ' ' || (match_id % 4) || '–' || (match_id % 3) || ' Team ' || ((match_id * 3 + 7) % 29)
      || ' · ' || CASE WHEN match_id % 2 = 0 THEN 'Cup A' ELSE 'Cup B' END || ' Group Stage' AS label
  FROM ev
)"""

SEGMENTS = """
runs0 AS (
  SELECT *, CASE WHEN lag(period) OVER w = period AND lag(possession) OVER w = possession THEN 0 ELSE 1 END AS opens
  FROM ev WHERE period <> 5 WINDOW w AS (PARTITION BY match_id ORDER BY index)
), runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY match_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS run FROM runs0
), seg AS MATERIALIZED (
  SELECT *, min(index) OVER r AS start_index,
    first_value(possession_team_id) OVER ro AS chain_team_id, first_value(ts_s) OVER ro AS chain_start_ts,
    row_number() OVER ro - 1 AS idx,
    team_id = first_value(possession_team_id) OVER ro AS ours
  FROM runs WINDOW r AS (PARTITION BY match_id, run), ro AS (PARTITION BY match_id, run ORDER BY index)
), segp AS (
  SELECT *, ours AND type_id <> 17 AND NOT admin AND x IS NOT NULL AS on_path,
    ours AND coalesce((type_id = 10 AND outcome_id IN (4, 15, 16, 17))
      OR (type_id = 4 AND sub_type_id = 11 AND outcome_id IN (4, 15, 16, 17))
      OR type_id = 2 OR type_id = 6 OR (type_id = 23 AND sub_type_id IN (25, 27, 34)), false) AS regain
  FROM seg
), chain0 AS (
  SELECT match_id, start_index,
    bool_or(x IS NOT NULL AND NOT admin) AS content,
    any_value(period) AS period, any_value(possession) AS possession, any_value(chain_team_id) AS team_id,
    any_value(chain_start_ts) AS start_ts, arg_min(minute, index) AS minute, arg_min(second, index) AS second,
    coalesce(max(ts_s + coalesce(duration, 0)) FILTER (NOT admin), max(ts_s + coalesce(duration, 0))) AS end_ts,
    arg_max(play_pattern_id, index) AS play_pattern_id,
    first(sub_type_id ORDER BY index) FILTER (ours AND type_id = 30) AS first_pass_type,
    count(*) AS n_events, count(*) FILTER (ours AND type_id = 30) AS n_passes,
    count(DISTINCT player_id) FILTER (ours) AS n_players,
    count(*) FILTER (ours AND type_id = 16) AS n_shots,
    count(*) FILTER (NOT ours AND type_id = 17) AS pressure_events,
    coalesce(arg_min(x, index) FILTER (on_path), 60) AS start_x, coalesce(arg_min(y, index) FILTER (on_path), 40) AS start_y,
    coalesce(arg_max(coalesce(end_x, x), index) FILTER (on_path), 60) AS end_x,
    coalesce(arg_max(coalesce(end_y, y), index) FILTER (on_path), 40) AS end_y,
    coalesce(max(greatest(x, coalesce(end_x, x))) FILTER (on_path), 60) AS max_x,
    coalesce(greatest(max(greatest(x, coalesce(end_x, x))) FILTER (on_path) - min(least(x, coalesce(end_x, x))) FILTER (on_path),
      max(greatest(y, coalesce(end_y, y))) FILTER (on_path) - min(least(y, coalesce(end_y, y))) FILTER (on_path)) > 0.01, false) AS path_moved,
    coalesce(bool_or((x >= 102 AND y BETWEEN 18 AND 62) OR (end_x >= 102 AND end_y BETWEEN 18 AND 62)) FILTER (on_path), false) AS reached_box,
    coalesce(bool_or(type_id = 16 AND outcome_id = 97) FILTER (ours), false) OR coalesce(bool_or(type_id = 20) FILTER (NOT ours), false) AS goal_for,
    coalesce(bool_or(type_id = 16 AND outcome_id IN (100, 116)) FILTER (ours), false) AS on_target,
    coalesce(bool_or(type_id = 16 AND outcome_id = 97) FILTER (NOT ours), false) OR coalesce(bool_or(type_id = 20) FILTER (ours), false) AS goal_conceded,
    bool_or(type_id = 34) AS half_end,
    coalesce(bool_or(pass_switch OR coalesce(abs(end_y - y) >= 40, false)) FILTER (ours AND type_id = 30), false) AS switch_of_play,
    coalesce(max(coalesce(xg, 0)) FILTER (ours AND type_id = 16), 0) AS xg,
    arg_max(type_id, index) FILTER (NOT admin AND type_id <> 17) AS end_type,
    last(outcome_id ORDER BY index) FILTER (NOT admin AND type_id <> 17) AS end_outcome,
    last(sub_type_id ORDER BY index) FILTER (NOT admin AND type_id <> 17) AS end_sub,
    arg_max(ours, index) FILTER (NOT admin AND type_id <> 17) AS end_ours,
    arg_max(is_out, index) FILTER (NOT admin AND type_id <> 17) AS end_out,
    min(index) FILTER (regain AND x IS NOT NULL) AS regain_index,
    arg_min(x, index) FILTER (regain AND x IS NOT NULL) AS regain_x_won,
    arg_min(counterpress, index) FILTER (regain AND x IS NOT NULL) AS regain_press_won,
    first(CASE WHEN ours THEN x ELSE round(120.1::DOUBLE - x, 1) END ORDER BY index) AS regain_x_first,
    arg_min(counterpress, index) AS regain_press_first,
    count(*) FILTER (has_frame) AS n_framed
  FROM segp GROUP BY match_id, start_index
), chain1 AS (
  SELECT *, row_number() OVER w AS seq, lag(team_id) OVER w AS prev_team_id, lag(period) OVER w AS prev_period
  FROM chain0 WHERE content WINDOW w AS (PARTITION BY match_id ORDER BY start_index)
), chain2 AS (
  SELECT *,
    EXISTS (SELECT 1 FROM ev p WHERE p.type_id = 17 AND p.match_id = c.match_id AND p.period = c.period AND p.team_id = c.team_id
            AND round(p.ts_s * 1000) BETWEEN round(c.start_ts * 1000) - 5000 AND round(c.start_ts * 1000)) AS press_before,
    CASE play_pattern_id WHEN 2 THEN 'corner' WHEN 3 THEN 'free_kick' WHEN 4 THEN 'throw_in' WHEN 7 THEN 'goal_kick' WHEN 9 THEN 'kick_off' END AS by_pattern,
    CASE first_pass_type WHEN 61 THEN 'corner' WHEN 62 THEN 'free_kick' WHEN 63 THEN 'goal_kick' WHEN 65 THEN 'kick_off' WHEN 67 THEN 'throw_in' END AS by_pass,
    CASE WHEN regain_index IS NULL THEN regain_x_first ELSE regain_x_won END AS regain_x,
    coalesce(CASE WHEN regain_index IS NULL THEN regain_press_first ELSE regain_press_won END, false) AS counterpress_regain,
    greatest(end_ts - start_ts, 0) AS duration_s, end_x - start_x AS yards
  FROM chain1 c
), chain3 AS (
  SELECT *, coalesce(by_pattern <> by_pass, false) AS pattern_disagreed,
    coalesce(by_pattern, by_pass, CASE WHEN prev_period = period AND prev_team_id <> team_id THEN 'turnover_open_play' ELSE 'regular' END) AS start_type,
    CASE WHEN goal_for THEN 'goal' WHEN on_target THEN 'shot_on_target' WHEN n_shots > 0 THEN 'shot_off_target'
      WHEN end_ours AND (end_type IN (38, 3, 37, 22) OR (end_type = 30 AND end_outcome IN (9, 77)) OR (end_type IN (42, 14) AND end_outcome = 9)) THEN 'lost_ball'
      WHEN NOT end_ours AND (end_type IN (10, 2, 4, 6, 9, 39) OR (end_type = 23 AND end_sub IN (25, 27, 34))) THEN 'lost_ball'
      WHEN end_out OR (end_type = 30 AND end_outcome IN (75, 76)) OR end_type = 8 THEN 'out_of_play'
      WHEN (end_type = 21 AND end_ours) OR (end_type = 22 AND NOT end_ours) THEN 'foul_won'
      WHEN half_end THEN 'end_of_period' ELSE 'lost_ball' END AS outcome,
    CASE WHEN duration_s > 0.05 THEN yards / duration_s ELSE 0 END AS speed_yd, max_x >= 80 AS reached_final_third
  FROM chain2
), chains AS MATERIALIZED (
  SELECT *, match_id || '-' || CASE WHEN seq < 10000 THEN lpad(seq::VARCHAR, 4, '0') ELSE seq::VARCHAR END AS phase_id,
    coalesce(start_type = 'turnover_open_play' AND regain_x >= 80 AND (counterpress_regain OR press_before), false) AS high_press_regain,
    play_pattern_id = 6 OR coalesce(start_type = 'turnover_open_play' AND regain_x <= 60 AND yards >= 18 AND speed_yd >= 4.3::DOUBLE AND reached_final_third, false) AS counterattack
  FROM chain3
)"""

ZONE = (
    "CASE WHEN {x} < 40 THEN 'def_third' WHEN {x} < 80 THEN 'mid_third' ELSE 'final_third' END || '_' ||"
    " CASE WHEN {y} < 80::DOUBLE / 3 THEN 'left' WHEN {y} < 160::DOUBLE / 3 THEN 'centre' ELSE 'right' END"
)

PHASES = f"""
phases AS MATERIALIZED (
  SELECT phase_id, c.match_id, seq, start_index, m.competition, m.label AS match_label, team_id,
    CASE WHEN team_id = home_team_id THEN home_team_name ELSE away_team_name END AS team_name,
    CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opponent_id,
    CASE WHEN team_id = home_team_id THEN away_team_name ELSE home_team_name END AS opponent_name,
    period, possession, minute, second, start_ts::FLOAT AS start_ts, end_ts::FLOAT AS end_ts,
    (CASE period WHEN 1 THEN 0 WHEN 2 THEN 2700 WHEN 3 THEN 5400 ELSE 6300 END + start_ts)::FLOAT AS abs_start_s,
    duration_s::FLOAT AS duration_s, n_events, n_passes, n_players, n_shots,
    {ZONE.format(x='start_x', y='start_y')} AS start_zone, {ZONE.format(x='end_x', y='end_y')} AS end_zone,
    start_x::FLOAT AS start_x, start_y::FLOAT AS start_y, end_x::FLOAT AS end_x, end_y::FLOAT AS end_y, max_x::FLOAT AS max_x,
    start_type, outcome, (yards * 0.9144::DOUBLE)::FLOAT AS progression_m, (speed_yd * 0.9144::DOUBLE)::FLOAT AS direct_speed_m_s,
    pressure_events, high_press_regain, counterattack, switch_of_play, reached_final_third, reached_box,
    xg::FLOAT AS xg, goal_conceded, n_framed > 0 AS has_360, (n_framed / n_events)::FLOAT AS frame_coverage
  FROM chains c JOIN matches m ON c.match_id = m.match_id
)"""


def resample(name: str, points: str, key: str) -> str:
    """CTEs giving ``{name}(key, i, x, y)``: 20 even points of ``points(key, pos, x, y)``."""
    k = [c.strip() for c in key.split(",")]
    on = " AND ".join(f"t.{c} = s.{c}" for c in k)
    tk = ", ".join(f"t.{c}" for c in k)
    return f"""
{name}_l AS (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM {points} WINDOW w AS (PARTITION BY {key} ORDER BY pos)
), {name}_d AS (
  SELECT *, CASE WHEN abs(x - px) > 0.01 OR abs(y - py) > 0.01 THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) ELSE 0 END AS d FROM {name}_l
), {name}_c AS MATERIALIZED (
  SELECT *, sum(d) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c1 FROM {name}_d
), {name}_t AS (
  SELECT {key}, max(c1) AS total, arg_min(x, pos) AS sx, arg_min(y, pos) AS sy, arg_max(x, pos) AS ex, arg_max(y, pos) AS ey
  FROM {name}_c GROUP BY {key}
), {name}_g AS (
  SELECT *, total * i / 19 AS target FROM {name}_t, range(20) r(i)
), {name} AS (
  SELECT {tk}, t.i, t.sx AS x, t.sy AS y FROM {name}_g t WHERE i = 0 OR total <= 0
  UNION ALL
  SELECT {tk}, t.i, t.ex, t.ey FROM {name}_g t WHERE i = 19 AND total > 0
  UNION ALL
  SELECT {tk}, t.i, s.px + (t.target - (s.c1 - s.d)) / s.d * (s.x - s.px), s.py + (t.target - (s.c1 - s.d)) / s.d * (s.y - s.py)
  FROM {name}_g t JOIN {name}_c s ON {on} AND s.d > 0 AND t.target > s.c1 - s.d AND t.target <= s.c1
  WHERE t.i BETWEEN 1 AND 18 AND t.total > 0
)"""


PATHS = """
pts AS (
  SELECT match_id, start_index, idx * 2 AS pos, x, y FROM segp WHERE on_path
  UNION ALL
  SELECT match_id, start_index, idx * 2 + 1, end_x, end_y FROM segp WHERE on_path AND end_x IS NOT NULL
),""" + resample("path0", "pts", "match_id, start_index") + """,
paths AS MATERIALIZED (
  SELECT p.phase_id, i, x::FLOAT AS x, y::FLOAT AS y FROM phases p JOIN path0 q ON p.match_id = q.match_id AND p.start_index = q.start_index
  UNION ALL
  SELECT p.phase_id, r.i, 60::FLOAT, 40::FLOAT FROM (SELECT phase_id, match_id, start_index FROM phases) p
  ANTI JOIN pts q ON p.match_id = q.match_id AND p.start_index = q.start_index CROSS JOIN range(20) r(i)
)"""

PHASE_EVENTS = """
pe AS MATERIALIZED (
  SELECT p.phase_id, s.match_id, s.idx, s.event_uuid, s.index AS event_index, (s.ts_s - s.chain_start_ts)::FLOAT AS t_offset_s,
    s.type_id, s.type_name, s.player_name, s.position_name, CASE WHEN s.ours THEN 'in_possession' ELSE 'opponent' END AS team_side,
    s.team_name,
    (CASE WHEN s.ours THEN s.x ELSE round(120.1::DOUBLE - s.x, 1) END)::FLOAT AS x, (CASE WHEN s.ours THEN s.y ELSE round(80.1::DOUBLE - s.y, 1) END)::FLOAT AS y,
    (CASE WHEN s.ours THEN s.end_x ELSE round(120.1::DOUBLE - s.end_x, 1) END)::FLOAT AS end_x,
    (CASE WHEN s.ours THEN s.end_y ELSE round(80.1::DOUBLE - s.end_y, 1) END)::FLOAT AS end_y,
    s.end_z::FLOAT AS end_z, s.outcome_name, s.under_pressure, s.counterpress, s.is_out AS "out", s.xg::FLOAT AS xg, s.has_frame,
    s.ours AND s.type_id <> 17 AND NOT s.admin AND s.x IS NOT NULL AS on_path, s.admin, s.ours
  FROM seg s JOIN phases p ON s.match_id = p.match_id AND s.start_index = p.start_index
)"""

FRAMES = """
fr AS (
  SELECT match_id, event_uuid, event_id, x, y, team_id, type_id, period,
    list_transform(range(0, 3 + event_id % 4), lambda i: {
      'teammate': (i + event_id) % 2 = 0,
      'actor': CASE event_id % 40 WHEN 5 THEN false WHEN 6 THEN i < 2 ELSE i = 0 END,
      'keeper': i = 2,
      'located': NOT (i = 3 AND event_id % 11 = 0),
      'fx': CASE WHEN i = 0 THEN CASE event_id % 40 WHEN 3 THEN 120.1::DOUBLE - x WHEN 4 THEN 120.1::DOUBLE - x + 0.5::DOUBLE ELSE x END
        ELSE ((event_id * 13 + i * 211) % 1200)::DOUBLE / 10::DOUBLE END,
      'fy': CASE WHEN i = 0 THEN CASE event_id % 40 WHEN 3 THEN 80.1::DOUBLE - y WHEN 4 THEN 80.1::DOUBLE - y + 0.5::DOUBLE ELSE y END
        ELSE ((event_id * 17 + i * 307) % 800)::DOUBLE / 10::DOUBLE END}) AS dots
  FROM ev WHERE has_frame
), fo AS (
  SELECT s.match_id, s.start_index, s.idx, s.ours, f.*  EXCLUDE (match_id),
    len(list_filter(dots, lambda d: d.actor)) AS n_actors,
    list_filter(dots, lambda d: d.actor)[1].fx AS ax, list_filter(dots, lambda d: d.actor)[1].fy AS ay
  FROM fr f JOIN seg s ON f.match_id = s.match_id AND f.event_uuid = s.event_uuid
), fq AS (
  SELECT *, CASE WHEN n_actors <> 1 THEN 'unknown' WHEN abs(ax - x) <= 1.5 AND abs(ay - y) <= 1.5 THEN 'event'
      WHEN abs(ax - (120.1::DOUBLE - x)) <= 1.5 AND abs(ay - (80.1::DOUBLE - y)) <= 1.5 THEN 'mirrored' ELSE 'unknown' END AS orientation,
    n_actors = 1 AND abs(ax - (120.1::DOUBLE - x)) < 0.0001 AND abs(ay - (80.1::DOUBLE - y)) < 0.0001 AS paired
  FROM fo
), pf AS MATERIALIZED (
  SELECT p.phase_id, q.match_id, q.idx, q.event_uuid, q.event_id, q.orientation, q.dots, q.ours, q.paired,
    (q.orientation <> 'mirrored') <> q.ours AS flip, q.ours <> (q.orientation = 'mirrored' AND q.paired) AS mate_ours
  FROM fq q JOIN phases p ON q.match_id = p.match_id AND q.start_index = p.start_index
)"""

# Columns of the vector in order.
_NUM = ("duration_s", "n_passes", "n_events", "n_players", "progression_m", "direct_speed_m_s",
        "pressure_events", "xg", "start_x", "start_y", "end_x", "end_y", "max_x")
_BOOL = ("high_press_regain", "counterattack", "switch_of_play", "reached_final_third", "reached_box")
_START = ("kick_off", "goal_kick", "corner", "free_kick", "throw_in", "turnover_open_play", "regular")
_OUT = ("goal", "shot_on_target", "shot_off_target", "lost_ball", "out_of_play", "foul_won", "end_of_period")
_ZONES = [f"{t}_{c}" for t in ("def_third", "mid_third", "final_third") for c in ("left", "centre", "right")]
_KEEP = (0, 2, 3, 5, 7, 9, 10, 12, 14, 16, 17, 19)

MOMENTS = "mom AS (SELECT " + ", ".join(
    f"avg({c}::DOUBLE) AS mu_{c}, CASE WHEN stddev_pop({c}::DOUBLE) < 1e-9 THEN 1 ELSE stddev_pop({c}::DOUBLE) END AS sd_{c}"
    for c in _NUM
) + " FROM phases)"


def vectors(name: str, rows: str, path: str, key: str) -> str:
    """CTEs giving ``{name}(key, vec)``: unit vectors of ``rows`` with path points in ``path``."""
    k = [c.strip() for c in key.split(",")]
    parts = [f"greatest(least((r.{c}::DOUBLE - mu_{c}) / sd_{c}, 3), -3)" for c in _NUM]
    parts += [f"CASE WHEN r.{c} THEN 0.8::DOUBLE ELSE 0 END" for c in _BOOL]
    for col, dom, w in (("start_type", _START, 0.7), ("outcome", _OUT, 0.7), ("start_zone", _ZONES, 0.6), ("end_zone", _ZONES, 0.6)):
        parts += [f"CASE WHEN r.{col} = '{v}' THEN {w}::DOUBLE ELSE 0 END" for v in dom]
    for i in _KEEP:
        parts += [f"(px[{i + 1}]::DOUBLE - 60) / 60 * 0.5::DOUBLE", f"(py[{i + 1}]::DOUBLE - 40) / 40 * 0.5::DOUBLE"]
    on = " AND ".join(f"r.{c} = q.{c}" for c in k)
    return f"""
{name}_p AS (
  SELECT {key}, list(x ORDER BY i) AS px, list(y ORDER BY i) AS py FROM {path} GROUP BY {key}
), {name}_r AS (
  SELECT {', '.join('r.' + c for c in k)}, [{', '.join(f'({p})::DOUBLE' for p in parts)}] AS raw
  FROM {rows} r JOIN {name}_p q ON {on}, mom
), {name} AS MATERIALIZED (
  SELECT {key}, list_transform(raw, lambda v: (v / norm)::FLOAT) AS vec
  FROM (SELECT *, sqrt(list_dot_product(raw, raw)) AS norm FROM {name}_r)
)"""


SIMILARITY = MOMENTS + "," + vectors("sim", "phases", "paths", "phase_id")

_LEVELS = {
    "events": [EVENTS],
    "segments": [EVENTS, SEGMENTS],
    "phases": [EVENTS, SEGMENTS, PHASES],
    "paths": [EVENTS, SEGMENTS, PHASES, PATHS],
    "phase_events": [EVENTS, SEGMENTS, PHASES, PHASE_EVENTS],
    "frames": [EVENTS, SEGMENTS, PHASES, PHASE_EVENTS, FRAMES],
    "similarity": [EVENTS, SEGMENTS, PHASES, PATHS, SIMILARITY],
    "all": [EVENTS, SEGMENTS, PHASES, PATHS, SIMILARITY, PHASE_EVENTS, FRAMES],
}


def on(level: str, body: str, *ctes: str) -> str:
    """A query over the tables of ``level`` plus its own CTEs."""
    return "WITH " + ",".join([*_LEVELS[level], *ctes]) + "\n" + body
