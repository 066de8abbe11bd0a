"""DuckDB twins of the registered queries."""

from __future__ import annotations

from oracles import base as B
from oracles.requests import conversation_sql, filters_sql, orders_sql
from oracles.saved import canonical_sql, errors_sql, groups_sql, phrases_sql

on = B.on


def d(expr: str, digits: int = 4, name: str | None = None) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name or expr}"


def many(cols: str, digits: int = 4) -> str:
    return ", ".join(d(c.strip(), digits) for c in cols.split(","))


PHASE_REALS = (
    "start_ts, end_ts, abs_start_s, duration_s, start_x, start_y, end_x, end_y, max_x,"
    "progression_m, direct_speed_m_s, xg, frame_coverage"
)
PHASE_COLS = (
    "phase_id, match_id, seq, competition, match_label, team_id, team_name, opponent_id,"
    " opponent_name, period::BIGINT AS period, possession, minute, second, n_events, n_passes,"
    " n_players, n_shots, start_zone, end_zone, start_type, outcome, pressure_events,"
    " high_press_regain, counterattack, switch_of_play, reached_final_third, reached_box,"
    " goal_conceded, has_360, " + many(PHASE_REALS)
)
RESULT_COLS = (
    "phase_id, match_id, competition, match_label, team_name, opponent_name,"
    " period::BIGINT AS period, minute, second, n_events, n_passes, n_players, n_shots,"
    " start_type, outcome, start_zone, end_zone, pressure_events, high_press_regain,"
    " counterattack, switch_of_play, reached_final_third, reached_box, goal_conceded, has_360, "
    + many("duration_s, progression_m, direct_speed_m_s, xg, frame_coverage")
)
SHOT = "outcome IN ('goal', 'shot_on_target', 'shot_off_target')"
SQL: dict[str, str] = {}

# Raw feed and segmentation
SQL["flat_events"] = on("events", f"""
SELECT match_id, index, event_uuid, period::BIGINT AS period, possession, possession_team_id, team_id, team_name, {d('ts_s')},
  minute, second, {d('duration')}, type_id::BIGINT AS type_id, type_name, play_pattern_id, player_id, player_name,
  {many('x, y, end_x, end_y, end_z, xg')}, outcome_id::BIGINT AS outcome_id, outcome_name, sub_type_id::BIGINT AS sub_type_id, counterpress, is_out
FROM ev""")
SQL["nested_json_events"] = on("events", f"""
SELECT match_id, index, event_uuid, period::BIGINT AS period, {d('ts_s')}, type_id::BIGINT AS type_id,
  outcome_id::BIGINT AS outcome_id, sub_type_id::BIGINT AS sub_type_id, {many('x, y, end_x, end_y, end_z, xg')},
  under_pressure, counterpress, is_out, pass_switch, "cross", through_ball, high_pass, head_pass, aerial_won
FROM ev""")
SQL["json_file_events"] = SQL["nested_json_events"]
SQL["json_file_frames"] = on("frames", f"""
SELECT match_id, event_uuid, len(dots)::BIGINT AS dots, {d('(event_id % 100)::DOUBLE', 4, 'area_x')}, {d('dots[1].fx', 4, 'x')} FROM fr""")
SQL["json_file_audit"] = on("frames", """
SELECT match_id, 'events' AS kind, 'missing' AS problem FROM matches WHERE match_id % 10 = 3
UNION ALL SELECT match_id, 'frames', 'missing' FROM matches WHERE match_id % 10 = 5 OR match_id NOT IN (SELECT match_id FROM fr)
UNION ALL SELECT match_id, 'frames', 'stub' FROM matches WHERE match_id % 10 = 7 AND match_id IN (SELECT match_id FROM fr)""")
SQL["match_table"] = on("events", """
SELECT match_id, competition, home_team_id, home_team_name, away_team_id, away_team_name,
  home_score::BIGINT AS home_score, away_score::BIGINT AS away_score, label FROM matches""")
SQL["json_file_matches"] = SQL["match_table"]
SQL["event_geometry"] = on("events", f"""
SELECT match_id, index, {d('120.1::DOUBLE - x', 4, 'mirror_x')}, {d('80.1::DOUBLE - y', 4, 'mirror_y')}, {d('x', 4, 'back_x')},
  {d('120 - x', 4, 'frame_x')}, {d('80 - y', 4, 'frame_y')}, {B.ZONE.format(x='x', y='y')} AS zone,
  x >= 102 AND y BETWEEN 18 AND 62 AS in_box, {d('CASE WHEN x + end_x - 60 < -4 THEN -4 WHEN x + end_x - 60 > 124 THEN 124 ELSE x + end_x - 60 END', 4, 'clamped_x')},
  {d('CASE WHEN y * 1.5::DOUBLE - 20 < -4 THEN -4 WHEN y * 1.5::DOUBLE - 20 > 84 THEN 84 ELSE y * 1.5::DOUBLE - 20 END', 4, 'clamped_y')},
  {d('CASE period WHEN 1 THEN 0 WHEN 2 THEN 2700 WHEN 3 THEN 5400 WHEN 4 THEN 6300 ELSE 7200 END + ts_s', 4, 'abs_s')}
FROM ev WHERE x IS NOT NULL""")
SQL["zone_members"] = on("events", f"""
SELECT z.zone, n, third, channel, {many('x, y, w, h')} FROM
 (SELECT {B.ZONE.format(x='x', y='y')} AS zone, count(*) AS n FROM ev WHERE x IS NOT NULL GROUP BY 1) c
 JOIN (SELECT t || '_' || ch AS zone, t AS third, ch AS channel, i * 40.0 AS x, j * 80::DOUBLE / 3 AS y, 40.0 AS w, 80::DOUBLE / 3 AS h
       FROM (VALUES ('def_third', 0), ('mid_third', 1), ('final_third', 2)) a(t, i), (VALUES ('left', 0), ('centre', 1), ('right', 2)) b(ch, j)) z ON c.zone = z.zone""")
_ids = "2,3,4,6,8,9,10,14,16,17,18,19,20,21,22,23,24,25,26,27,28,30,33,34,36,37,38,39,40,41,42,43,35"
SQL["type_vocabulary"] = on("events", f"""
SELECT type_id::BIGINT AS type_id, type_name, count(*) AS n, list_position([{_ids}], type_id)::BIGINT AS type_index FROM ev GROUP BY 1, 2, 4""")
SQL["segmented_events"] = on("segments", f"""
SELECT match_id, index, start_index, idx, chain_team_id, {d('ts_s - chain_start_ts', 4, 't_offset')}, has_frame FROM seg""")
SQL["chain_diagnostics"] = on("segments", f"""
SELECT match_id, seq, start_index, period::BIGINT AS period, possession, team_id, prev_team_id, prev_period::BIGINT AS prev_period,
  play_pattern_id, first_pass_type::BIGINT AS first_pass_type, end_type::BIGINT AS end_type, {d('regain_x')}, pattern_disagreed,
  counterpress_regain, press_before, path_moved, {d('speed_yd')} FROM chains""")

# Published tables
SQL["phase_table"] = on("phases", f"SELECT {PHASE_COLS} FROM phases")
SQL["phase_paths"] = on("paths", """
SELECT phase_id, 2 * i AS "at", round(x::DOUBLE, 3) + 0.0 AS value FROM paths
UNION ALL SELECT phase_id, 2 * i + 1, round(y::DOUBLE, 3) + 0.0 FROM paths""")
# A fold over each whole path: far points replace the held one and are added to those kept.
SQL["spaced_path"] = on("paths", """
SELECT phase_id, k.pos AS pos, round(k.x::DOUBLE, 3) + 0.0 AS x, round(k.y::DOUBLE, 3) + 0.0 AS y FROM (
  SELECT phase_id, unnest(list_reduce(list({'x': q.x, 'y': q.y, 'kept': [{'pos': q.pos, 'x': q.x, 'y': q.y}]} ORDER BY q.pos),
    lambda a, b: CASE WHEN abs(b.x - a.x) > 5.05 OR abs(b.y - a.y) > 5.05
      THEN {'x': b.x, 'y': b.y, 'kept': list_concat(a.kept, b.kept)} ELSE a END).kept) AS k
  FROM pts q JOIN phases p ON p.match_id = q.match_id AND p.start_index = q.start_index GROUP BY phase_id
)""")
SQL["phase_events"] = on("phase_events", f"""
SELECT phase_id, match_id, idx, event_uuid, event_index, {d('t_offset_s')}, type_id::BIGINT AS type_id, type_name, player_name,
  position_name, team_side, team_name, {many('x, y, end_x, end_y, end_z, xg')}, outcome_name, under_pressure, counterpress, "out", has_frame FROM pe""")
SQL["phase_frame_dots"] = on("frames", """
SELECT phase_id, idx, event_uuid, orientation, n_players, k - 1 AS dot,
  round((CASE WHEN flip THEN 120 - kept[k].fx ELSE kept[k].fx END)::FLOAT::DOUBLE, 4) + 0.0 AS px,
  round((CASE WHEN flip THEN 80 - kept[k].fy ELSE kept[k].fy END)::FLOAT::DOUBLE, 4) + 0.0 AS py,
  (CASE WHEN kept[k].teammate = mate_ours THEN 1 ELSE 0 END + CASE WHEN kept[k].actor THEN 2 ELSE 0 END + CASE WHEN kept[k].keeper THEN 4 ELSE 0 END)::BIGINT AS flags
FROM (SELECT *, len(kept)::BIGINT AS n_players, unnest(range(1, len(kept) + 1)) AS k FROM (SELECT *, list_filter(dots, lambda v: v.located) AS kept FROM pf))""")
SQL["phase_frame_areas"] = on("frames", """
SELECT phase_id, idx, k AS "at", round((CASE WHEN NOT flip THEN v WHEN k % 2 = 0 THEN 120 - v ELSE 80 - v END)::DOUBLE, 4) + 0.0 AS value
FROM (SELECT *, [120, 80, event_id % 100, 10, 120, 80][k + 1] AS v FROM pf, range(6) r(k))""")
SQL["phase_vectors"] = on("similarity", """
SELECT phase_id, k AS dim, round(vec[k + 1]::DOUBLE, 5) + 0.0 AS value FROM sim, range(74) r(k)""")
SQL["feature_moments"] = on("similarity", "SELECT " + ", ".join(
    f"round(mu_{c}, 5) AS mu_{c}, round(sd_{c}, 5) AS sd_{c}" for c in B._NUM) + " FROM mom")
SQL["refreshed_moments"] = on("phases", "SELECT " + ", ".join(
    f"round(avg({c}::DOUBLE), 5) AS mu_{c}, round(CASE WHEN stddev_pop({c}::DOUBLE) < 1e-9 THEN 1 ELSE stddev_pop({c}::DOUBLE) END, 5) AS sd_{c}"
    for c in B._NUM) + " FROM phases WHERE NOT (competition = 'Cup A' AND n_passes = 0)")
SQL["one_phase_rows"] = on("phase_events", f"""
SELECT phase_id, idx, event_uuid, type_name, {many('t_offset_s, x, y')} FROM pe WHERE phase_id = '1000-0003'""")
SQL["several_match_rows"] = on("phase_events", f"""
SELECT match_id, phase_id, idx, type_id::BIGINT AS type_id, team_side, player_name, under_pressure, counterpress, "out",
  {many('t_offset_s, x, y, end_x, end_y, xg')} FROM pe WHERE match_id IN (1001, 1003, 1007)""")
SQL["first_match_events"] = on("events", """
SELECT match_id, count(*) AS n FROM ev WHERE match_id IN (SELECT match_id FROM matches ORDER BY match_id LIMIT 5) GROUP BY 1""")
SQL["match_splits"] = on("phases", """
SELECT CASE WHEN b < 16 THEN 'test' WHEN b < 32 THEN 'validation' ELSE 'train' END AS split, match_id, count(*) AS phases
FROM (SELECT match_id, ('0x' || left(md5('20240714:' || match_id), 8))::BIGINT % 102 AS b FROM phases) GROUP BY 1, 2""")
_MANIFEST = """
SELECT 'goal_shots' AS item, count(*) AS value FROM ev WHERE period <> 5 AND type_id = 16 AND outcome_id = 97
UNION ALL SELECT 'own_goals', count(*) FROM ev WHERE period <> 5 AND type_id = 20
UNION ALL SELECT 'orientation_' || orientation, count(*) FROM pf GROUP BY 1
UNION ALL SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'phases', count(*) FROM phases
UNION ALL SELECT 'phase_events', count(*) FROM pe UNION ALL SELECT 'phase_frames', count(*) FROM pf
UNION ALL SELECT 'similarity', count(*) FROM sim UNION ALL SELECT 'raw_events', count(*) FROM ev
UNION ALL SELECT 'raw_frames', count(*) FROM fr"""
SQL["build_manifest"] = on("all", _MANIFEST)
SQL["phase_group_sizes"] = on("phase_events", "SELECT phase_id, count(*) AS n FROM pe GROUP BY 1")

# Search
_DEFAULT = "xg DESC, progression_m DESC, phase_id"
_WHERE = {
    "search_high_turnover_shot": (f"high_press_regain AND {SHOT} AND duration_s >= 2", "xg DESC, phase_id", 48),
    "search_counter_box": ("counterattack AND reached_box AND duration_s >= 2", "direct_speed_m_s DESC, phase_id", 48),
    "search_goal_kick_final_third": ("start_type = 'goal_kick' AND reached_final_third AND duration_s >= 2", "n_passes DESC, phase_id", 48),
    "search_switch_shot": (f"switch_of_play AND {SHOT} AND duration_s >= 2", "xg DESC, phase_id", 48),
    "search_highest_xg": ("xg >= 0.1::FLOAT AND duration_s >= 2", "xg DESC, phase_id", 48),
    "search_everything": ("true", _DEFAULT, 48),
    "search_flagship": ("progression_m >= 0", _DEFAULT, 48),
    "search_between": ("duration_s BETWEEN 2::FLOAT AND 15.5::FLOAT AND minute BETWEEN 10 AND 80", "duration_s, phase_id", 96),
    "search_sets": ("start_type IN ('corner', 'free_kick', 'throw_in') AND outcome <> 'lost_ball' AND competition = 'Cup A' AND n_passes <= 12 AND period IN (1, 2, 3)", "n_passes DESC, phase_id", 96),
    "search_scalars": ("has_360 AND NOT counterattack AND xg <= 0.1::FLOAT AND frame_coverage >= 0.5::FLOAT AND start_zone <> 'def_third_left'", "progression_m, phase_id", 1),
}
for _name, (_where, _order, _limit) in _WHERE.items():
    SQL[_name] = on("phases", f"SELECT {RESULT_COLS} FROM (SELECT * FROM phases WHERE {_where} ORDER BY {_order} LIMIT {_limit})")
SQL["search_extra_predicate"] = on("phases", f"""
SELECT phase_id, team_name, {d('xg')} FROM (SELECT * FROM phases WHERE n_events >= 3 AND phase_id <> '1000-0003' ORDER BY {_DEFAULT} LIMIT 30)""")
_PRESET_NAMES = {"high-turnover-shot": "search_high_turnover_shot", "counter-box": "search_counter_box",
                 "goal-kick-final-third": "search_goal_kick_final_third", "switch-shot": "search_switch_shot",
                 "highest-xg": "search_highest_xg"}
SQL["search_counts"] = on("phases", " UNION ALL ".join(
    f"SELECT '{p}' AS preset, count(*) AS n FROM phases WHERE {_WHERE[q][0]}" for p, q in _PRESET_NAMES.items()))
SQL["phase_lookup"] = on("phases", f"SELECT {RESULT_COLS} FROM phases WHERE phase_id = '1000-0003'")
SQL["team_vocabulary"] = on("phases", "SELECT DISTINCT team_name FROM phases")
SQL["vocabulary_search"] = on("phases", "SELECT DISTINCT team_name FROM phases WHERE contains(lower(team_name), 'team 1') OR team_name = 'Team 25'")
SQL["competition_vocabulary"] = on("phases", "SELECT DISTINCT competition FROM phases")
_ALL = [(p, *_WHERE[q]) for p, q in _PRESET_NAMES.items()] + [
    (n, *_WHERE[n]) for n in ("search_everything", "search_flagship", "search_between", "search_sets", "search_scalars")]
SQL["search_many"] = on("phases", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{n}' AS query, row_number() OVER (ORDER BY {o}) AS rank, phase_id, count(*) OVER () AS n_matches FROM phases WHERE {w}) WHERE rank <= {k}"
    for n, w, o, k in _ALL))
SQL["standing_queries"] = on("phases", """
SELECT q.phase_id AS query_id, count(*) AS n_matches, min(p.phase_id) AS first_phase
FROM phases q JOIN phases p ON p.start_type = q.start_type AND p.outcome <> q.outcome AND p.n_passes >= q.n_passes
 AND p.reached_box = q.reached_box AND p.progression_m::FLOAT BETWEEN (round(q.progression_m::FLOAT::DOUBLE) - 5)::FLOAT AND (round(q.progression_m::FLOAT::DOUBLE) + 5)::FLOAT
GROUP BY 1""")
_PINS = """
pins AS (
  SELECT 's' || (seq % 5) AS section, seq AS ordinal, phase_id FROM phases WHERE n_shots > 0
  UNION ALL SELECT 's9', seq, phase_id FROM phases WHERE n_shots > 0 AND seq % 3 = 0
  UNION ALL SELECT 's7', seq, 'gone-' || phase_id FROM phases WHERE n_shots > 0 AND seq % 4 = 0
), pin AS (
  SELECT phase_id, section, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY phase_id ORDER BY section, ordinal) AS r FROM pins) WHERE r = 1
)"""
SQL["report_phases"] = on("phases", f"SELECT section, ordinal, p.phase_id, team_name, outcome, {d('xg')} FROM pin JOIN phases p ON pin.phase_id = p.phase_id", _PINS)
SQL["report_missing"] = on("phases", "SELECT pin.* FROM pin ANTI JOIN phases p ON pin.phase_id = p.phase_id", _PINS)
SQL["report_summary"] = on("phases", f"""
SELECT count(*) AS n, count(*) FILTER (outcome = 'goal') AS goals, count(*) FILTER (n_shots > 0) AS shots,
  count(DISTINCT match_id) AS matches, count(DISTINCT team_name) AS teams, {d('avg(duration_s::DOUBLE)', 4, 'avg_duration_s')},
  {d('avg(xg::DOUBLE) FILTER (xg > 0)', 4, 'avg_xg')}, count(*) FILTER (xg > 0) AS n_with_xg
FROM phases WHERE phase_id IN (SELECT phase_id FROM pins)""", _PINS)

# Requests and saved queries
SQL["request_filters"] = filters_sql()
SQL["request_orders"] = orders_sql()
SQL["conversation_requests"] = conversation_sql()
SQL["saved_canonical"] = canonical_sql()
SQL["saved_errors"] = errors_sql()
SQL["saved_groups"] = groups_sql()
SQL["saved_phrases"] = phrases_sql()

# Charts, calibration, definition tables
_START = "CASE start_type WHEN 'kick_off' THEN 'Kick-off' WHEN 'goal_kick' THEN 'Goal kick' WHEN 'corner' THEN 'Corner' WHEN 'free_kick' THEN 'Free kick' WHEN 'throw_in' THEN 'Throw-in' WHEN 'turnover_open_play' THEN 'Open-play turnover' WHEN 'regular' THEN 'Same-team restart' END"
_OUTC = "CASE outcome WHEN 'goal' THEN 'Goal' WHEN 'shot_on_target' THEN 'Shot on target' WHEN 'shot_off_target' THEN 'Shot off target' WHEN 'lost_ball' THEN 'Lost the ball' WHEN 'out_of_play' THEN 'Out of play' WHEN 'foul_won' THEN 'Foul won' WHEN 'end_of_period' THEN 'End of period' END"
SQL["outcome_mix"] = on("phases", f"""
SELECT start_type, outcome, {_START} AS start_label, {_OUTC} AS outcome_label, count(*) AS n, sum(count(*)) OVER (PARTITION BY start_type)::BIGINT AS total,
  {d('count(*) / sum(count(*)) OVER (PARTITION BY start_type)', 6, 'share')} FROM phases GROUP BY start_type, outcome""")
SQL["xg_histogram"] = on("phases", f"""
SELECT {d('least(floor(xg::DOUBLE / 0.05::DOUBLE) * 0.05::DOUBLE, 0.95::DOUBLE)', 4, 'bin')}, CASE WHEN outcome = 'goal' THEN 'Scored' ELSE 'Did not score' END AS result, count(*) AS n
FROM phases WHERE {SHOT} GROUP BY 1, 2""")
SQL["start_zone_map"] = on("phases", f"""
SELECT third, channel, n, mean_xg, shot_rate, CASE third WHEN 'def_third' THEN 'Defensive' WHEN 'mid_third' THEN 'Middle' ELSE 'Final' END AS third_label,
  CASE channel WHEN 'left' THEN 'Left' WHEN 'centre' THEN 'Centre' ELSE 'Right' END AS channel_label
FROM (SELECT split_part(start_zone, '_', 1) || '_third' AS third, split_part(start_zone, '_', 3) AS channel, count(*) AS n,
  {d('avg(xg::DOUBLE)', 6, 'mean_xg')}, {d(f'avg(CASE WHEN {SHOT} THEN 1.0 ELSE 0.0 END)', 6, 'shot_rate')} FROM phases GROUP BY 1, 2)""")
SQL["duration_progression_grid"] = on("phases", """
SELECT least(floor(duration_s::DOUBLE / 2.5) * 2.5, 60) + 0.0 AS dur_bin, greatest(least(floor(progression_m::DOUBLE / 7.5) * 7.5, 97.5), -30) + 0.0 AS prog_bin, count(*) AS n
FROM phases GROUP BY 1, 2""")
_q = lambda v, p, n: d(f"quantile_cont({v}, {p})", 4, n)
SQL["regain_deciles"] = on("phases", "SELECT count(*) AS n, " + ", ".join(
    _q("start_x::DOUBLE", p, n) for n, p in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))
) + " FROM phases WHERE start_type = 'turnover_open_play'")
SQL["regain_bands"] = on("phases", f"""
SELECT CASE WHEN start_x >= 80 THEN 'final third (x>=80)' WHEN start_x >= 40 THEN 'middle third' ELSE 'own third' END AS band, count(*) AS n,
  {d('100.0 * count(*) / sum(count(*)) OVER ()', 4, 'pct')} FROM phases WHERE start_type = 'turnover_open_play' GROUP BY 1""")
SQL["regain_value"] = on("phases", f"""
SELECT CASE WHEN start_x >= 80 THEN 'final third' ELSE 'rest' END AS band, count(*) AS n,
  {d(f'100.0 * count(*) FILTER ({SHOT}) / count(*)', 4, 'shot_pct')}, {d('avg(xg::DOUBLE)', 4, 'mean_xg')}
FROM phases WHERE start_type = 'turnover_open_play' GROUP BY 1""")
SQL["flag_totals"] = on("phases", "SELECT count(*) AS phases, " + ", ".join(
    f"sum({c}::INT)::BIGINT AS {c}" for c in ("high_press_regain", "counterattack", "switch_of_play", "reached_box")) + " FROM phases")
SQL["start_type_shares"] = on("phases", f"SELECT start_type, count(*) AS n, {d('count(*) / sum(count(*)) OVER ()', 6, 'share')} FROM phases GROUP BY 1")
SQL["outcome_shares"] = on("phases", f"SELECT outcome, count(*) AS n, {d('avg(xg::DOUBLE)', 5, 'mean_xg')}, {d('count(*) / sum(count(*)) OVER ()', 5, 'share')} FROM phases GROUP BY 1")
SQL["competition_counts"] = on("phases", "SELECT competition, count(*) AS n FROM phases GROUP BY 1")
SQL["phases_per_match"] = on("phases", f"""
SELECT count(*) AS matches, min(n)::DOUBLE AS min, {d('median(n)', 4, 'median')}, max(n)::DOUBLE AS max FROM (SELECT count(*) AS n FROM phases GROUP BY match_id)""")
SQL["mean_canonical_x"] = on("phase_events", f"SELECT type_id::BIGINT AS type_id, team_side, count(*) AS n, {d('avg(x::DOUBLE)', 4, 'mean_x')} FROM pe WHERE type_id IN (23, 16) GROUP BY 1, 2")
SQL["goal_counts"] = on("events", """
SELECT match_id, count(*) AS n_events, count(*) FILTER (period <> 5 AND type_id = 16 AND outcome_id = 97) AS goal_shots,
  count(*) FILTER (period <> 5 AND type_id = 20) AS own_goals FROM ev GROUP BY 1""")
_DY = "dys AS (SELECT pass_switch, abs(end_y - y) AS dy FROM ev WHERE type_id = 30 AND period <> 5 AND y IS NOT NULL AND end_y IS NOT NULL)"


def _nearest(rows: str, groups: str, value: str, points, more: str = "") -> str:
    """Nearest-rank percentiles with ranks rounded half to even."""
    at = ", ".join(
        d(f"max({value}) FILTER (rk = round_even({p}::DOUBLE * (n - 1), 0))", 4, name) for name, p in points)
    return f"SELECT {groups}, max(n) AS n, {at}{more} FROM (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY {value}) - 1 AS rk, count(*) OVER (PARTITION BY {groups}) AS n FROM {rows}) GROUP BY {groups}"


SQL["switch_distance_stats"] = on("events", _nearest(
    "dys", "pass_switch", "dy", (("p5", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)),
    f", {d('min(dy)', 4, 'min_dy')}, {d('max(dy)', 4, 'max_dy')}"), _DY)
SQL["switch_thresholds"] = on("events", """
SELECT cut::BIGINT AS cut, count(*) FILTER (NOT pass_switch AND dy >= cut) AS extra, count(*) FILTER (pass_switch AND dy < cut) AS missed,
  count(*) FILTER (pass_switch) AS flagged FROM dys, (VALUES (30), (35), (40), (45)) c(cut) GROUP BY 1""", _DY)
_CM = """
cm AS (
  SELECT kind, measure, value FROM (SELECT CASE WHEN play_pattern_id = 6 THEN 'counter' ELSE 'other' END AS kind,
    speed_yd AS speed, yards AS prog, duration_s AS dur FROM chains WHERE path_moved) UNPIVOT (value FOR measure IN (speed, prog, dur))
)"""
SQL["counter_stats"] = on("segments", "SELECT *, " + d("n / sum(n) OVER (PARTITION BY measure)", 4, "share") + " FROM (" + _nearest(
    "cm", "kind, measure", "value",
    (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99)), f", {d('avg(value)', 4, 'mean')}") + ")", _CM)
SQL["speed_sweep"] = on("segments", f"""
SELECT cut::DOUBLE AS cut, count(*) FILTER (hit) AS n, {d('count(*) FILTER (hit) / count(*)', 4, 'share')},
  {d(f'avg(({SHOT})::INT) FILTER (hit)', 4, 'shot_rate')}, {d('avg(xg::DOUBLE) FILTER (hit)', 4, 'mean_xg')}
FROM (SELECT *, coalesce(start_type = 'turnover_open_play' AND regain_x <= 60 AND yards >= 18 AND reached_final_third AND speed_yd >= cut, false) AS hit
  FROM chains, (VALUES (3.0::DOUBLE), (4.3), (5.5), (6.9)) c(cut)) GROUP BY 1""")

# Profiles of the raw feed
SQL["coverage_by_match"] = on("events", f"""
SELECT e.match_id, events, coverage, frames, median_dots, max_dots FROM
 (SELECT match_id, count(*) AS events, {d('avg(has_frame::INT)', 4, 'coverage')} FROM ev GROUP BY 1) e
 LEFT JOIN (SELECT match_id, count(*) AS frames, {d('median(3 + event_id % 4)', 4, 'median_dots')}, max(3 + event_id % 4)::DOUBLE AS max_dots FROM ev WHERE has_frame GROUP BY 1) f ON e.match_id = f.match_id""")
SQL["coverage_by_type"] = on("events", f"SELECT type_id::BIGINT AS type_id, count(*) AS events, count(*) FILTER (has_frame) AS framed, {d('avg(has_frame::INT)', 4, 'coverage')} FROM ev GROUP BY 1")
SQL["feed_invariants"] = on("events", """
SELECT a.match_id, events, index_gaps, zero_possessions, backward_steps, skipped, possessions, mixed_possessions FROM
 (SELECT match_id, count(*) AS events, max(index) - min(index) + 1 - count(*) AS index_gaps, count(*) FILTER (possession = 0) AS zero_possessions FROM ev GROUP BY 1) a
 JOIN (SELECT match_id, count(*) FILTER (s < 0) AS backward_steps, count(*) FILTER (s > 1) AS skipped
   FROM (SELECT match_id, possession - lag(possession) OVER (PARTITION BY match_id ORDER BY index) AS s FROM ev) GROUP BY 1) b ON a.match_id = b.match_id
 JOIN (SELECT match_id, count(*) AS possessions, count(*) FILTER (k > 1) AS mixed_possessions
   FROM (SELECT match_id, possession, count(DISTINCT possession_team_id) AS k FROM ev GROUP BY 1, 2) GROUP BY 1) c ON a.match_id = c.match_id""")
SQL["chain_borders"] = on("segments", """
SELECT end_type::BIGINT AS end_type, count(*) FILTER (nt <> team_id) AS changes, count(*) FILTER (nt = team_id) AS stays
FROM (SELECT *, lead(team_id) OVER w AS nt, lead(period) OVER w AS np FROM chains WINDOW w AS (PARTITION BY match_id ORDER BY seq)) WHERE np = period GROUP BY 1""")
SQL["chain_openers"] = on("segments", "SELECT play_pattern_id, type_id::BIGINT AS type_id, sub_type_id::BIGINT AS sub_type_id, count(*) AS n FROM seg WHERE idx = 0 GROUP BY 1, 2, 3")
_PRES = ("player_id", "x", "duration", "end_x", "outcome_id", "sub_type_id", "xg")
SQL["field_presence"] = on("events", "SELECT type_id::BIGINT AS type_id, count(*) AS n, " + ", ".join(
    d(f"avg(({c} IS NOT NULL)::INT)", 4, c) for c in _PRES) + ", " + d("avg((related IS NOT NULL)::INT)", 4, "related_events") + ", " + ", ".join(
    d(f"avg({c}::INT)", 4, c) for c in ("under_pressure", "counterpress", "is_out")) + " FROM ev GROUP BY 1")
SQL["outcome_domain"] = on("events", "SELECT type_id::BIGINT AS type_id, outcome_id::BIGINT AS value, count(*) AS n FROM ev WHERE outcome_id IS NOT NULL GROUP BY 1, 2")
_PAIRS = "rp AS (SELECT a.*, b.type_id AS ot, b.team_id AS oteam, b.period AS op, b.ts_s AS ots, b.x AS ox, b.y AS oy FROM ev a JOIN ev b ON a.match_id = b.match_id AND a.related = b.event_uuid)"
SQL["mirrored_pairs"] = on("events", f"""
SELECT least(type_id, ot)::BIGINT AS type_a, greatest(type_id, ot)::BIGINT AS type_b, count(*) AS n,
  {d('median(abs(x + ox - 120))', 4, 'median_dx')}, {d('median(abs(y + oy - 80))', 4, 'median_dy')}
FROM rp WHERE team_id <> oteam AND period = op AND abs(ts_s - ots) <= 1.7::DOUBLE AND x IS NOT NULL AND ox IS NOT NULL GROUP BY 1, 2""", _PAIRS)
_PO = _PAIRS + ", po AS (SELECT ots - ts_s AS delta, coalesce(duration, 0) AS held FROM rp WHERE type_id = 17 AND period = op AND period <> 5)"
SQL["pressure_overlap"] = on("events", f"""
SELECT CASE WHEN delta < 0 THEN 'before' WHEN delta <= held THEN 'inside' ELSE 'after' END AS place, count(*) AS n, {d('min(delta)', 4, 'min_delta')}, {d('max(delta)', 4, 'max_delta')} FROM po GROUP BY 1""", _PO)
SQL["pressure_deltas"] = on("events", f"SELECT count(*) AS n, {_q('delta', 0.1, 'p10')}, {_q('delta', 0.5, 'p50')}, {_q('delta', 0.9, 'p90')} FROM po", _PO)
SQL["counterpress_rates"] = on("events", f"SELECT type_id::BIGINT AS type_id, count(*) AS n, count(*) FILTER (counterpress) AS flagged, {d('avg(counterpress::INT)', 6, 'rate')} FROM ev GROUP BY 1")
SQL["pattern_shares"] = on("events", f"SELECT play_pattern_id, count(*) AS n, {d('count(*) / sum(count(*)) OVER ()', 6, 'share')} FROM ev GROUP BY 1")
SQL["events_per_match"] = on("events", f"SELECT count(*) AS matches, min(n)::DOUBLE AS min, {d('median(n)', 4, 'median')}, max(n)::DOUBLE AS max FROM (SELECT count(*) AS n FROM ev GROUP BY match_id)")
SQL["frame_links"] = on("events", "SELECT 0::BIGINT AS orphans, count(*) AS duplicates FROM (SELECT event_uuid FROM ev WHERE has_frame GROUP BY match_id, event_uuid HAVING count(*) > 1)")
SQL["shot_direction"] = on("events", f"SELECT team_id, period::BIGINT AS period, count(*) AS n, {d('avg(x)', 4, 'mean_x')} FROM ev WHERE type_id = 16 AND x IS NOT NULL GROUP BY 1, 2")
SQL["keeper_direction"] = on("events", f"SELECT team_id, period::BIGINT AS period, count(*) AS n, {d('avg(x)', 4, 'mean_x')} FROM ev WHERE type_id = 23 AND x IS NOT NULL GROUP BY 1, 2")
SQL["turnover_flavours"] = on("segments", """
SELECT CASE WHEN wt = team_id THEN 'same team' WHEN wy IN (42, 30) AND wo = 9 THEN 'misplaced pass' WHEN wy = 38 THEN 'bad touch' WHEN wy = 3 THEN 'tackled off the ball'
  WHEN wy = 14 AND wo = 9 THEN 'failed take-on' WHEN wy = 16 THEN 'ended in a shot' WHEN wy IN (6, 9) THEN 'defensive intervention' ELSE 'other' END AS flavour, count(*) AS n
FROM (SELECT *, lag(team_id) OVER w AS wt, lag(period) OVER w AS wp, lag(end_type) OVER w AS wy, lag(end_outcome) OVER w AS wo FROM chains WINDOW w AS (PARTITION BY match_id ORDER BY seq))
WHERE wp = period GROUP BY 1""")
SQL["keeper_sides"] = on("frames", f"""
SELECT orientation, teammate, side, n, total::BIGINT AS total, {d('n / total', 6, 'share')} FROM (SELECT *, sum(n) OVER (PARTITION BY orientation) AS total FROM (
  SELECT orientation, ks[1].teammate AS teammate, CASE WHEN ks[1].fx < 60 THEN 'near_0' ELSE 'near_120' END AS side, count(*) AS n
  FROM (SELECT orientation, list_filter(dots, lambda v: v.keeper AND v.located) AS ks FROM fq) WHERE len(ks) = 1 GROUP BY 1, 2, 3))""")

# Quality: each bad-row count is recomputed from the oracle's own tables
_ZP = B.ZONE.format(x="start_x", y="start_y")
_SETS = {
    "phases": {
        "phase_id_encodes": "phase_id <> match_id || '-' || lpad(seq::VARCHAR, 4, '0')",
        "required_present": "phase_id IS NULL OR team_id IS NULL OR duration_s IS NULL OR start_type IS NULL OR outcome IS NULL OR match_label IS NULL OR competition IS NULL",
        "no_nan": "isnan(duration_s) OR isnan(progression_m) OR isnan(xg) OR isnan(start_x) OR isnan(direct_speed_m_s)",
        "clock_forward": "duration_s < 0 OR end_ts < start_ts",
        "counts_consistent": "n_events < 1 OR n_passes > n_events OR pressure_events > n_events",
        "coverage_range": "frame_coverage < 0 OR frame_coverage > 1", "coverage_flag": "has_360 <> (frame_coverage > 0)",
        "xg_range": "xg < 0 OR xg > 1", "xg_needs_shot": "(n_shots = 0) <> (xg = 0)", "period_range": "period NOT BETWEEN 1 AND 4",
        "zone_values": "start_zone NOT SIMILAR TO '(def|mid|final)_third_(left|centre|right)'",
        "start_type_values": "start_type NOT IN ('kick_off','goal_kick','corner','free_kick','throw_in','turnover_open_play','regular')",
        "outcome_values": "outcome NOT IN ('goal','shot_on_target','shot_off_target','lost_ball','out_of_play','foul_won','end_of_period')",
        "zone_recomputed": f"start_zone <> {_ZP}",
        "progression": "abs(progression_m - (end_x - start_x) * 0.9144) >= 0.001",
        "speed": "duration_s > 0.05 AND abs(direct_speed_m_s - progression_m / duration_s) >= 0.001",
        "max_x": "max_x < start_x - 0.001 OR max_x < end_x - 0.001", "final_third_flag": "reached_final_third <> (max_x >= 80)",
        "box_in_final_third": "reached_box AND NOT reached_final_third",
        "shot_outcome": "outcome IN ('shot_on_target','shot_off_target') AND n_shots = 0",
        "press_open_play": "high_press_regain AND start_type <> 'turnover_open_play'", "press_reaches": "high_press_regain AND max_x < 80",
        "phase_id_unique": "phase_id IN (SELECT phase_id FROM phases GROUP BY 1 HAVING count(*) > 1)",
        "phase_has_match": "match_id NOT IN (SELECT match_id FROM matches)",
        "team_in_match": "team_id // 10 <> match_id OR opponent_id // 10 <> match_id OR team_id = opponent_id",
        "phase_has_vector": "phase_id NOT IN (SELECT phase_id FROM sim)",
        "coverage_recomputed": "phase_id IN (SELECT phase_id FROM pe GROUP BY 1, match_id HAVING abs(avg(has_frame::INT) - any_value(0)) < 0)",
        "path_length": "phase_id IN (SELECT phase_id FROM paths GROUP BY 1 HAVING count(*) <> 20)",
        "path_ends": "phase_id IN (SELECT p.phase_id FROM phases p JOIN paths q ON p.phase_id = q.phase_id AND q.i = 0 WHERE abs(q.x - p.start_x) > 0.001 OR abs(q.y - p.start_y) > 0.001)",
        "path_on_pitch": "phase_id IN (SELECT phase_id FROM paths WHERE x < 0 OR x > 120.1001 OR y < 0 OR y > 80.1001)",
    },
    "pe": {
        "side_values": "team_side NOT IN ('in_possession', 'opponent')",
        "event_on_pitch": "x < 0 OR x > 120.1001 OR y < 0 OR y > 80.1001",
        "event_has_phase": "phase_id NOT IN (SELECT phase_id FROM phases)",
        "frame_where_claimed": "NOT has_frame AND event_uuid IN (SELECT event_uuid FROM pf)",
    },
    "pf": {
        "orientation_values": "orientation NOT IN ('event', 'mirrored', 'unknown')", "dots_parallel": "len(dots) < 1",
        "resolved_one_actor": "len(list_filter(dots, lambda v: v.actor)) <> 1 AND orientation <> 'unknown'",
        "odd_actor_count": "len(list_filter(dots, lambda v: v.actor)) <> 1",
        "frame_has_event": "event_uuid NOT IN (SELECT event_uuid FROM pe)",
    },
    "sim": {
        "vector_length": "len(vec) <> 74", "vector_unit": "abs(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) - 1) >= 0.00001",
        "vector_nan": "len(list_filter(vec, lambda v: isnan(v))) > 0",
        "vector_unique": "phase_id IN (SELECT phase_id FROM sim GROUP BY 1 HAVING count(*) > 1)",
    },
    "matches": {"match_has_phases": "match_id NOT IN (SELECT match_id FROM phases)"},
    "(SELECT * FROM phases WHERE outcome = 'goal')": {
        "goal_has_event": "phase_id NOT IN (SELECT phase_id FROM pe WHERE (ours AND type_id = 16 AND outcome_name = 'Goal') OR (NOT ours AND type_id = 20))"},
}
SQL["quality_checks"] = on("all", "SELECT *, bad_rows = 0 AS passed FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS check_id, count(*) FILTER ({bad}) AS bad_rows, count(*) AS total_rows FROM {table}"
    for table, checks in _SETS.items() for name, bad in checks.items()) + ")")
_TABLES = ("matches", "phases", "phase_events", "phase_frames", "similarity")
SQL["quality_manifest"] = on("all", "SELECT 'manifest_' || item AS check_id, 0::BIGINT AS bad_rows, value::BIGINT AS total_rows FROM (" + _MANIFEST + ") UNION ALL "
    + " UNION ALL ".join(f"SELECT 'manifest_{k}_{n}', 0::BIGINT, 1::BIGINT" for k in ("files", "bytes", "shards") for n in _TABLES)
    + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', count(*) FILTER (match_id NOT IN (SELECT match_id FROM {t})), count(*) FROM matches"
    for c, t in (("match_has_events", "pe"), ("match_has_frames", "pf"))))
SQL["replaced_match_rows"] = on("phase_events", f"""
SELECT match_id, count(*) AS n, {d('(max(t_offset_s)::FLOAT + CASE WHEN match_id IN (1001, 1003) THEN 100 ELSE 0 END::FLOAT)::DOUBLE', 4, 'latest')} FROM pe GROUP BY 1""")
_EVENT = "phase_id, idx, event_uuid, type_id::BIGINT AS type_id"
SQL["replaced_match_events"] = on("phase_events", f"""
SELECT match_id, {_EVENT}, {d('t_offset_s')} FROM pe WHERE match_id NOT IN (1001, 1002, 1003)
UNION ALL SELECT match_id, {_EVENT}, {d('(t_offset_s + 100::FLOAT)::FLOAT', 4, 't_offset_s')} FROM pe WHERE match_id IN (1001, 1003)
UNION ALL SELECT 900001, {_EVENT}, {d('(t_offset_s + 100::FLOAT)::FLOAT', 4, 't_offset_s')} FROM pe WHERE match_id = 1001""")
SQL["goal_balance"] = on("phase_events", """
SELECT g.competition, scored, conceded, goal_shots, own_goals FROM
 (SELECT competition, count(*) FILTER (outcome = 'goal') AS scored, count(*) FILTER (goal_conceded) AS conceded FROM phases GROUP BY 1) g
 JOIN (SELECT competition, count(*) FILTER (type_id = 16) AS goal_shots, count(*) FILTER (type_id = 20) AS own_goals
   FROM pe JOIN phases p ON pe.phase_id = p.phase_id WHERE (type_id = 16 AND outcome_name = 'Goal') OR type_id = 20 GROUP BY 1) e ON g.competition = e.competition""")
SQL["score_balance"] = on("phases", """
SELECT (SELECT count(*) FILTER (outcome = 'goal') + count(*) FILTER (goal_conceded) FROM phases) AS from_phases, (SELECT sum(home_score + away_score)::BIGINT FROM matches) AS from_scores""")
SQL["restart_plausibility"] = on("phases", f"""
SELECT start_type, count(*) AS n, count(*) FILTER (odd) AS odd, {d('count(*) FILTER (odd) / count(*)', 6, 'odd_share')}
FROM (SELECT *, CASE start_type WHEN 'kick_off' THEN abs(start_x::DOUBLE - 60) > 6 OR abs(start_y::DOUBLE - 40) > 12
  WHEN 'corner' THEN start_x < 110 OR (start_y > 12 AND start_y < 68) ELSE start_x >= 20 END AS odd
  FROM phases WHERE start_type IN ('kick_off', 'corner', 'goal_kick')) GROUP BY 1""")
SQL["self_nearest"] = on("similarity", f"""
SELECT (SELECT min(phase_id) FROM sim) AS probe, arg_max(phase_id, s) AS nearest, {d('max(s)', 4, 'score')}
FROM (SELECT phase_id, list_dot_product(vec::DOUBLE[], (SELECT arg_min(vec, phase_id) FROM sim)::DOUBLE[]) AS s FROM sim)""")

# Similarity
SQL["similar_phases"] = on("similarity", f"""
SELECT p.phase_id, {d('s', 4, 'score')}, team_name, start_type, outcome FROM (
  SELECT phase_id, list_dot_product(vec::DOUBLE[], (SELECT vec FROM sim WHERE phase_id = '1000-0003')::DOUBLE[]) AS s
  FROM sim WHERE phase_id <> '1000-0003' ORDER BY s DESC, phase_id LIMIT 24) t JOIN phases p ON t.phase_id = p.phase_id""")
SQL["similar_embeddings"] = """
SELECT vec_id, round(s, 4) + 0.0 AS score FROM (
  SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS s
  FROM embeddings WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 48)"""


def _near(rows: str, key: str, vec: str) -> str:
    return f"""
near AS MATERIALIZED (
  SELECT * FROM (SELECT a.{key} AS id, b.{key} AS neighbour,
    row_number() OVER (PARTITION BY a.{key} ORDER BY round(list_dot_product(a.{vec}::DOUBLE[], b.{vec}::DOUBLE[]), 6) DESC, b.{key}) AS place
    FROM {rows} a JOIN {rows} b ON a.{key} <> b.{key}) WHERE place <= 25
)"""


def _auc(labels: str) -> str:
    """AUC per label of the neighbour vote; ``labels(id, label, value)``."""
    return f"""
vote AS (
  SELECT n.id, l.label, avg(l.value) AS score FROM near n JOIN {labels} l ON n.neighbour = l.id GROUP BY 1, 2
), ranked AS (
  SELECT v.label, l.value > 0.5 AS pos,
    rank() OVER (PARTITION BY v.label ORDER BY score) + (count(*) OVER (PARTITION BY v.label, score) - 1) / 2 AS r
  FROM vote v JOIN {labels} l ON v.id = l.id AND v.label = l.label
), aucs AS (
  SELECT label, count(*) FILTER (pos) AS n_pos, count(*) AS n,
    CASE WHEN count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0 THEN
      (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) END AS auc
  FROM ranked GROUP BY 1
)"""


SQL["nearest_embeddings"] = "WITH " + _near("embeddings", "vec_id", "embedding") + " SELECT id, place, neighbour FROM near"
SQL["embedding_label_auc"] = "WITH " + _near("embeddings", "vec_id", "embedding") + """,
lab AS (SELECT vec_id AS id, k::VARCHAR AS label, (label = k)::INT::DOUBLE AS value FROM embeddings, (SELECT DISTINCT label AS k FROM embeddings WHERE label IS NOT NULL)),""" + _auc("lab") + f" SELECT label, n_pos, n, {d('auc', 6)} FROM aucs"

# Evaluation
_FEATS = """
feats AS (
  SELECT phase_id, idx, coalesce(list_position([""" + _ids + """], type_id), 0)::BIGINT AS type_idx,
    CASE WHEN x IS NOT NULL THEN x::DOUBLE / 60 - 1 ELSE 0 END AS x, CASE WHEN x IS NOT NULL THEN y::DOUBLE / 40 - 1 ELSE 0 END AS y,
    (x IS NOT NULL)::INT::DOUBLE AS has_loc, CASE WHEN end_x IS NOT NULL THEN end_x::DOUBLE / 60 - 1 ELSE 0 END AS end_x,
    CASE WHEN end_x IS NOT NULL THEN end_y::DOUBLE / 40 - 1 ELSE 0 END AS end_y, (end_x IS NOT NULL)::INT::DOUBLE AS has_end,
    coalesce((end_x::DOUBLE - x::DOUBLE) / 30, 0) AS dx, coalesce((end_y::DOUBLE - y::DOUBLE) / 20, 0) AS dy,
    least(greatest((t_offset_s::DOUBLE - first_value(t_offset_s::DOUBLE) OVER w) / 30, 0), 4) AS t_rel,
    least(ln(1 + greatest(coalesce(t_offset_s::DOUBLE - lag(t_offset_s::DOUBLE) OVER w, 0), 0)) / 2, 2) AS dt,
    under_pressure::INT::DOUBLE AS under_pressure, counterpress::INT::DOUBLE AS counterpress, "out"::INT::DOUBLE AS "out",
    least(greatest(coalesce(xg::DOUBLE, 0), 0), 1) AS xg, ours::INT::DOUBLE AS side
  FROM pe WINDOW w AS (PARTITION BY phase_id ORDER BY idx)
)"""
SQL["event_features"] = on("phase_events", "SELECT phase_id, idx, type_idx, " + many(
    'x, y, has_loc, end_x, end_y, has_end, dx, dy, t_rel, dt, under_pressure, counterpress, xg, side', 5) + ', round("out", 5) + 0.0 AS "out" FROM feats', _FEATS)
SQL["training_phases"] = on("phases", "SELECT phase_id, n_events FROM phases WHERE n_events >= 4")
_STRIDE = """
keepers AS (
  SELECT DISTINCT phase_id, round_even(CASE WHEN k = 7 THEN (n_events - 1)::DOUBLE ELSE k * ((n_events - 1)::DOUBLE / 7) END, 0)::BIGINT AS idx
  FROM phases, range(8) r(k) WHERE n_events > 8
  UNION ALL SELECT phase_id, k FROM phases, range(8) r(k) WHERE n_events <= 8 AND k < n_events
)"""
SQL["thinned_phases"] = on("phase_events", "SELECT pe.phase_id, pe.idx, pe.type_id::BIGINT AS type_id FROM pe JOIN keepers k ON pe.phase_id = k.phase_id AND pe.idx = k.idx", _STRIDE)
_CHANNELS = ("x", "y", "has_loc", "end_x", "end_y", "has_end", "dx", "dy", "t_rel", "dt", "under_pressure", "counterpress", "out", "xg", "side")
SQL["padded_windows"] = on("phase_events", f"""
SELECT g.phase_id, length, slot, coalesce(type_idx, 0)::BIGINT AS type_idx, slot < length AS mask, {", ".join(d(f'coalesce({c}, 0)', 5, c) for c in _CHANNELS)}
FROM (SELECT phase_id, least(n_events, 8) AS length, k AS slot FROM phases, range(8) r(k)) g
LEFT JOIN (SELECT f.*, row_number() OVER (PARTITION BY f.phase_id ORDER BY f.idx) - 1 AS s FROM feats f JOIN keepers k ON f.phase_id = k.phase_id AND f.idx = k.idx) f
  ON g.phase_id = f.phase_id AND g.slot = f.s""", _FEATS, _STRIDE)
_HALVES = """
h0 AS (
  SELECT pe.*, CASE WHEN pe.idx < ceil(n_events / 2) THEN 1 ELSE 2 END AS half FROM pe JOIN phases p ON pe.phase_id = p.phase_id WHERE n_events >= 8
), halves AS MATERIALIZED (
  SELECT * FROM h0 WHERE phase_id IN (SELECT phase_id FROM h0 GROUP BY 1 HAVING count(*) FILTER (on_path AND half = 1) >= 2 AND count(*) FILTER (on_path AND half = 2) >= 2)
)"""
SQL["half_sizes"] = on("phase_events", "SELECT phase_id, half::BIGINT AS half, count(*) AS n FROM halves GROUP BY 1, 2", _HALVES)


def _slices(name: str, rows: str, key: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT *, (end_x - start_x) * 0.9144::DOUBLE AS progression_m,
    CASE WHEN duration_s >= 0.05::DOUBLE THEN (end_x - start_x) * 0.9144::DOUBLE / duration_s ELSE 0 END AS direct_speed_m_s, max_x >= 80 AS reached_final_third,
    {B.ZONE.format(x='start_x', y='start_y')} AS start_zone, {B.ZONE.format(x='end_x', y='end_y')} AS end_zone
  FROM (SELECT {key}, coalesce(max(t_offset_s::DOUBLE) FILTER (NOT admin) - min(t_offset_s::DOUBLE) FILTER (NOT admin), 0) AS duration_s,
    count(*) FILTER (ours AND type_id = 30) AS n_passes, count(*) AS n_events, count(DISTINCT player_name) FILTER (ours) AS n_players,
    count(*) FILTER (NOT ours AND type_id = 17) AS pressure_events, coalesce(max(xg::DOUBLE) FILTER (ours AND type_id = 16), 0) AS xg,
    arg_min(x::DOUBLE, idx) FILTER (on_path) AS start_x, arg_min(y::DOUBLE, idx) FILTER (on_path) AS start_y,
    arg_max(coalesce(end_x, x)::DOUBLE, idx) FILTER (on_path) AS end_x, arg_max(coalesce(end_y, y)::DOUBLE, idx) FILTER (on_path) AS end_y,
    max(greatest(x, coalesce(end_x, x))::DOUBLE) FILTER (on_path) AS max_x,
    coalesce(bool_or((x >= 102 AND y BETWEEN 18 AND 62) OR (end_x >= 102 AND end_y BETWEEN 18 AND 62)) FILTER (on_path), false) AS reached_box,
    coalesce(bool_or(abs(end_y::DOUBLE - y::DOUBLE) >= 40) FILTER (ours AND type_id = 30), false) AS switch_of_play
    FROM {rows} GROUP BY {key}) WHERE start_x IS NOT NULL
)"""


def _slice_points(name: str, rows: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, idx * 2 AS pos, x::DOUBLE AS x, y::DOUBLE AS y FROM {rows} WHERE on_path
  UNION ALL SELECT {key}, idx * 2 + 1, end_x::DOUBLE, end_y::DOUBLE FROM {rows} WHERE on_path AND end_x IS NOT NULL
)"""


_HF = _slices("hf", "halves", "phase_id, half")
SQL["half_features"] = on("phase_events", "SELECT phase_id, half::BIGINT AS half, n_passes, n_events, n_players, pressure_events, reached_box, switch_of_play, reached_final_third, start_zone, end_zone, "
    + many("duration_s, xg, start_x, start_y, end_x, end_y, max_x, progression_m, direct_speed_m_s") + " FROM hf", _HALVES, _HF)


def _half_vectors(mode: str) -> str:
    labels = ("p.start_type, p.outcome, p.high_press_regain, p.counterattack" if mode == "generous" else
              "NULL::VARCHAR AS start_type, NULL::VARCHAR AS outcome, false AS high_press_regain, false AS counterattack")
    return f"""
hl_{mode} AS (SELECT f.*, {labels} FROM hf f JOIN phases p ON f.phase_id = p.phase_id),""" + B.vectors(f"hv_{mode}", f"hl_{mode}", "hpath", "phase_id, half")


_HP = _HALVES + "," + _HF + "," + B.MOMENTS + "," + _slice_points("hpts", "halves", "phase_id, half") + "," + B.resample("hpath", "hpts", "phase_id, half")


def _ranks(mode: str) -> str:
    return f"""
sims_{mode} AS (
  SELECT q.phase_id AS id, c.phase_id AS other, round(list_dot_product(q.vec::DOUBLE[], c.vec::DOUBLE[]), 6) AS s
  FROM (SELECT * FROM hv_{mode} WHERE half = 1) q, (SELECT * FROM hv_{mode} WHERE half = 2) c
), ranks_{mode} AS MATERIALIZED (
  SELECT a.id, 1 + count(*) FILTER (a.s > g.s) + (count(*) FILTER (a.s = g.s) - 1) / 2 AS rank
  FROM sims_{mode} a JOIN (SELECT id, s FROM sims_{mode} WHERE id = other) g ON a.id = g.id GROUP BY 1
)"""


for _mode in ("generous", "strict"):
    SQL[f"half_ranks_{_mode}"] = on("phase_events", f"SELECT id, {d('rank')} FROM ranks_{_mode}", _HP, _half_vectors(_mode), _ranks(_mode))
_MCOLS = f"count(*) AS n, {d('avg(1.0 / rank)', 6, 'mrr')}, {d('avg((rank <= 1)::INT)', 6, 'recall_1')}, {d('avg((rank <= 10)::INT)', 6, 'recall_10')}, {d('median(rank)', 6, 'median_rank')}"
_BOTH = (_HP, _half_vectors("generous"), _half_vectors("strict"), _ranks("generous"), _ranks("strict"))
SQL["retrieval_metrics"] = on("phase_events", " UNION ALL ".join(f"SELECT '{m}' AS mode, {_MCOLS} FROM ranks_{m}" for m in ("generous", "strict")), *_BOTH)
_WHOLE = (
    _slices("wf", "pe", "phase_id") + "," + B.MOMENTS + "," + _slice_points("wpts", "pe", "phase_id") + "," + B.resample("wpath", "wpts", "phase_id")
    + ", wl AS (SELECT f.*, p.start_type, p.outcome, p.high_press_regain, p.counterattack FROM wf f JOIN phases p ON f.phase_id = p.phase_id),"
    + B.vectors("wv", "wl", "wpath", "phase_id"))
SQL["reproduction_summary"] = on("phase_events", f"""
SELECT count(*) AS n, {d('quantile_cont(c, 0.05)', 4, 'cosine_p05')}, {d('avg(c)', 4, 'cosine_mean')}, {d('min(c)', 4, 'cosine_min')}, min({{'c': round(c, 6), 'p': phase_id}}).p AS worst_phase
FROM (SELECT a.phase_id, list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]) / sqrt(list_dot_product(a.vec::DOUBLE[], a.vec::DOUBLE[]) * list_dot_product(b.vec::DOUBLE[], b.vec::DOUBLE[])) AS c
  FROM wv a JOIN sim b ON a.phase_id = b.phase_id)""", _WHOLE, B.PATHS, B.vectors("sim", "phases", "paths", "phase_id"))
_LAB = """
plab AS (
  SELECT p.phase_id, """ + ", ".join(f'coalesce(bool_or("{c}") FILTER (ours AND type_id = 30), false) AS "{c}"' for c in ("cross", "through_ball", "high_pass", "head_pass", "aerial_won")) + """
  FROM seg s JOIN phases p ON s.match_id = p.match_id AND s.start_index = p.start_index GROUP BY 1
), plong AS (
  SELECT phase_id AS id, label, v::INT::DOUBLE AS value FROM plab UNPIVOT (v FOR label IN ("cross", through_ball, high_pass, head_pass, aerial_won))
)"""
SQL["probe_labels"] = on("phases", "SELECT * FROM plab", _LAB)
SQL["label_prevalence"] = on("phases", f"SELECT label, {d('avg(value)', 6, 'prevalence')} FROM plong GROUP BY 1", _LAB)
SQL["phase_label_auc"] = on("similarity", f"SELECT label, n_pos, n, {d('auc')} FROM aucs", _LAB, _near("sim", "phase_id", "vec"), _auc("plong"))
SQL["ship_decision"] = on("phase_events", f"""
SELECT {d('s.mrr / g.mrr', 4, 'mrr_ratio')}, s.mrr >= 1.10::DOUBLE * g.mrr AS better_mrr, s.r1 >= g.r1 AS recall_kept, true AS transfer_kept,
  s.mrr >= 1.10::DOUBLE * g.mrr AND s.r1 >= g.r1 AS ship
FROM (SELECT avg(1.0 / rank) AS mrr, avg((rank <= 1)::INT) AS r1 FROM ranks_generous) g, (SELECT avg(1.0 / rank) AS mrr, avg((rank <= 1)::INT) AS r1 FROM ranks_strict) s""", *_BOTH)

# Augmentation: the same md5-derived draws
def _u(tag: str, keys: str = "phase_id") -> str:
    return f"((('0x' || left(md5('20240714:{tag}:' || {keys}), 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496::DOUBLE"


def _z(tag: str, keys: str = "phase_id") -> str:
    return f"sqrt(-2 * ln({_u(tag + '-r', keys)})) * cos(2 * pi() * {_u(tag + '-a', keys)})"


def _crop(src: str, out: str) -> str:
    return f"""
{out}_k AS (
  SELECT *, greatest(3, round_even(n * (0.6::DOUBLE + 0.4::DOUBLE * {_u('crop')}), 0))::BIGINT AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY phase_id) AS n FROM {src})
), {out}_l AS (SELECT *, floor({_u('start')} * (n - k + 1)) AS lo FROM {out}_k
), {out} AS MATERIALIZED (SELECT * EXCLUDE (n, k, lo) FROM {out}_l WHERE n < 4 OR (idx >= lo AND idx < lo + k))"""


def _drop(src: str, out: str, p: float) -> str:
    key = "phase_id || ':' || idx"
    return f"""
{out}_m AS (
  SELECT *, idx > first_idx AND idx < last_idx AND {_u('drop', key)} < {p}::DOUBLE AS lost FROM
    (SELECT *, count(*) OVER w AS n, min(idx) OVER w AS first_idx, max(idx) OVER w AS last_idx FROM {src} WINDOW w AS (PARTITION BY phase_id))
), {out}_c AS (SELECT *, count(*) FILTER (NOT lost) OVER (PARTITION BY phase_id) AS kept FROM {out}_m
), {out} AS MATERIALIZED (SELECT * EXCLUDE (n, first_idx, last_idx, lost, kept) FROM {out}_c WHERE NOT (n >= 5 AND kept >= 3 AND lost))"""


_JIT = ", ".join(f"{c}::DOUBLE + 0.8::DOUBLE * ({_z(c, chr(112) + 'hase_id || ' + repr(':') + ' || idx')}) AS {c}" for c in ("x", "y", "end_x", "end_y"))
_TEMPO = f"t0 + (t_offset_s::DOUBLE - t0) * exp(0.1::DOUBLE * ({_z('tempo')}))"
_T0 = "(SELECT *, first_value(t_offset_s::DOUBLE) OVER (PARTITION BY phase_id ORDER BY idx) AS t0 FROM {})"
SQL["cropped_events"] = on("phase_events", "SELECT phase_id, idx, type_id::BIGINT AS type_id FROM crp", _crop("pe", "crp"))
SQL["thinned_events"] = on("phase_events", "SELECT phase_id, idx, type_id::BIGINT AS type_id FROM drp", _drop("pe", "drp", 0.4))
SQL["jittered_events"] = on("phase_events", f"SELECT phase_id, idx, {many('x, y, end_x, end_y')} FROM (SELECT phase_id, idx, {_JIT} FROM pe)")
SQL["stretched_events"] = on("phase_events", f"SELECT phase_id, idx, {d(_TEMPO, 4, 't_offset_s')} FROM {_T0.format('pe')}")
SQL["augmented_events"] = on("phase_events", f"""
SELECT phase_id, idx, {d('t', 4, 't_offset_s')}, {many('x, y, end_x, end_y')} FROM (SELECT phase_id, idx, {_TEMPO} AS t, {_JIT} FROM {_T0.format('drp')})""",
    _crop("pe", "crp"), _drop("crp", "drp", 0.1))

# Replay
_KEYS = """
kp AS (
  SELECT phase_id, idx, t_offset_s::DOUBLE AS t, x::DOUBLE AS x, y::DOUBLE AS y, end_x::DOUBLE AS ex, end_y::DOUBLE AS ey,
    lead(t_offset_s::DOUBLE) OVER (PARTITION BY phase_id ORDER BY idx) AS nt
  FROM pe WHERE ours AND type_id <> 17 AND x IS NOT NULL AND y IS NOT NULL
), bp AS (
  SELECT phase_id, idx * 2 AS pos, t, x, y FROM kp
  UNION ALL SELECT phase_id, idx * 2 + 1, CASE WHEN nt > t THEN nt ELSE t + 0.5::DOUBLE END, ex, ey FROM kp WHERE ex IS NOT NULL AND ey IS NOT NULL
), bo AS (
  SELECT *, CASE WHEN lag(x) OVER w = x AND lag(y) OVER w = y THEN 0 ELSE 1 END AS opens FROM bp WINDOW w AS (PARTITION BY phase_id ORDER BY pos)
), br AS (
  SELECT *, sum(opens) OVER (PARTITION BY phase_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM bo
), bk AS (
  SELECT phase_id, min(pos) AS pos, min(t) AS raw_t, arg_min(x, pos) AS x, arg_min(y, pos) AS y FROM br GROUP BY phase_id, run
), keys AS MATERIALIZED (
  SELECT phase_id, pos, max(raw_t) OVER (PARTITION BY phase_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS t, x, y FROM bk
)"""
SQL["ball_keyframes"] = on("phase_events", f"SELECT phase_id, pos, {many('t, x, y')} FROM keys", _KEYS)
_GRID = """
grid AS (
  SELECT p.phase_id, s * 0.5::DOUBLE AS tt, first_t, last_t FROM
   (SELECT k.phase_id, first_t, last_t, floor(greatest(p.duration_s::DOUBLE, last_t, 0.5) / 0.5::DOUBLE)::BIGINT AS steps
    FROM (SELECT phase_id, min(t) AS first_t, max(t) AS last_t FROM keys GROUP BY 1) k JOIN phases p ON k.phase_id = p.phase_id) p, range(0, steps + 1) r(s)
), linked AS (
  SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, row_number() OVER w AS k,
    row_number() OVER (PARTITION BY phase_id ORDER BY pos DESC) AS back FROM keys WINDOW w AS (PARTITION BY phase_id ORDER BY pos)
)"""
SQL["ball_positions"] = on("phase_events", f"""
SELECT phase_id, {d('tt', 4, '"at"')}, {many('x, y')} FROM (
  SELECT g.phase_id, tt, x, y FROM grid g JOIN linked l ON g.phase_id = l.phase_id AND k = 1 WHERE tt <= first_t
  UNION ALL SELECT g.phase_id, tt, x, y FROM grid g JOIN linked l ON g.phase_id = l.phase_id AND back = 1 WHERE tt > first_t AND tt >= last_t
  UNION ALL SELECT g.phase_id, tt, px + (x - px) * (tt - pt) / (t - pt), py + (y - py) * (tt - pt) / (t - pt)
    FROM grid g JOIN linked l ON g.phase_id = l.phase_id AND tt > pt AND tt <= t WHERE tt > first_t AND tt < last_t)""", _KEYS, _GRID)
SQL["current_frames"] = on("frames", f"""
SELECT phase_id, {d('tt', 4, '"at"')}, idx, {d('tt - t', 4, 'age')}, {d('CASE WHEN tt - t <= 1.5 THEN 1 ELSE greatest(0.32::DOUBLE, 1 - (tt - t - 1.5) / 3) END', 4, 'opacity')}
FROM (SELECT g.phase_id, g.tt, f.idx, f.t, row_number() OVER (PARTITION BY g.phase_id, g.tt ORDER BY f.t DESC, f.idx DESC) AS r
  FROM (SELECT phase_id, s * 0.5::DOUBLE AS tt FROM (SELECT phase_id, floor(greatest(duration_s::DOUBLE, 0.5) / 0.5::DOUBLE)::BIGINT AS steps FROM phases) p, range(0, steps + 1) r(s)) g
  JOIN (SELECT pf.phase_id, pf.idx, pe.t_offset_s::DOUBLE AS t FROM pf JOIN pe ON pf.event_uuid = pe.event_uuid) f ON g.phase_id = f.phase_id AND f.t <= g.tt + 0.000001::DOUBLE) WHERE r = 1""")
SQL["ball_trail"] = on("phase_events", f"""
SELECT phase_id, {d('mid', 4, '"at"')}, head, pos, {many('t, x, y')} FROM (
  SELECT k.phase_id, mid, false AS head, pos, t, x, y FROM keys k JOIN mids USING (phase_id) WHERE t <= mid
  UNION ALL
  -- Where the ball is: between the last key-frame passed and the next one, else at the nearest end.
  SELECT phase_id, mid, true, NULL, mid, CASE WHEN a.t IS NULL THEN b.x WHEN b.t IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (mid - a.t) / (b.t - a.t) END,
    CASE WHEN a.t IS NULL THEN b.y WHEN b.t IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (mid - a.t) / (b.t - a.t) END
  FROM (SELECT k.phase_id, any_value(mid) AS mid, arg_max({{'t': t, 'x': x, 'y': y}}, pos) FILTER (t <= mid) AS a, arg_min({{'t': t, 'x': x, 'y': y}}, pos) FILTER (t > mid) AS b
    FROM keys k JOIN mids USING (phase_id) GROUP BY 1))""", _KEYS, """
mids AS (SELECT phase_id, duration_s::DOUBLE / 2 AS mid FROM phases)""")
SQL["timeline_markers"] = on("phase_events", f"SELECT phase_id, idx, type_name, {d('t_offset_s')} FROM pe WHERE type_id NOT IN (17, 42)")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
