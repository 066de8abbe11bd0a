"""Plain-word requests and saved-query jobs."""

from __future__ import annotations

import pytest

from phasegrid.operators import requests as R, saved as SV

TEAMS = ["England", "Spain", "Italy", "North Macedonia", "Macedonia", "Czech Republic", "Oman", "Romania"]
SHOTS = "outcome in goal,shot_on_target,shot_off_target"
CASES = {
    "high turnovers leading to a shot": {"high_press_regain eq true", SHOTS},
    "counterattacks that reached the box": {"counterattack eq true", "reached_box eq true"},
    "goals on the break": {"counterattack eq true", "outcome eq goal"},
    "phases where they changed the point of attack": {"switch_of_play eq true"},
    "goals": {"outcome eq goal"},
    "phases from a goal kick": {"start_type eq goal_kick"},
    "goal-kick build-ups that reached the final third": {"start_type eq goal_kick", "reached_final_third eq true"},
    "build-up from the back": {"start_type eq goal_kick"},
    "long possessions ending in the box": {"duration_s gte 20.0", "n_passes gte 8.0", "reached_box eq true"},
    "quick vertical attacks": {"direct_speed_m_s gte 3.0"},
    "phases under 12 seconds": {"duration_s lte 12.0"},
    "phases over 30.5 seconds": {"duration_s gte 30.5"},
    "phases with 10+ passes": {"n_passes gte 10.0"},
    "possessions with at least 15 passes": {"n_passes gte 15.0"},
    "attacks from a throw-in": {"start_type eq throw_in"},
    "phases from a kick-off": {"start_type eq kick_off"},
    "big chances": {"xg gte 0.1"},
    "phases played under pressure": {"pressure_events gte 1.0"},
    "with a freeze frame": {"has_360 eq true"},
    "switches starting in the defensive third": {
        "switch_of_play eq true", "start_zone in def_third_left,def_third_centre,def_third_right"},
    "phases starting wide in the middle third": {"start_zone in mid_third_left,mid_third_right"},
    "phases starting centrally in the final third": {"start_zone in final_third_centre"},
    "counterattacks by england": {"counterattack eq true", "team_name eq England"},
    "north  macedonia phases": {"team_name eq North Macedonia"},
    "Romania or Oman": {"team_name eq Romania"},
    "Romanians": set(),
    "switches in 2020": {"switch_of_play eq true", "competition eq Euro 2020"},
    "the best chances of the Euros": {"xg gte 0.1"},
    "long possession under 10 seconds over 25 seconds": {"duration_s gte 25.0", "duration_s lte 10.0", "n_passes gte 8.0"},
    "high turnover regain": {"high_press_regain eq true"},
    "won the ball back": {"start_type eq turnover_open_play"},
    "cornerstone": {"start_type eq corner"},
    "a goalless spell": set(),
    "qwertyuiop": set(),
    "": set(),
    "Spain phases against Italy": {"team_name eq Spain"},
    "phases vs. Italy": set(),
}
DROPPED = {
    "Spain phases against Italy": "opponent", "shots by Cristiano Ronaldo": "Cristiano Ronaldo",
    "goals in the final": "date or round", "phases on 2024-07-14": "date or round",
    "counterattacks while winning": "scoreline", "a 2 – 1 lead": "scoreline",
    "phases with a cross into the box": "event-level", "by the goalkeeper": "role",
}
ORDERS = {
    "the best chances": ("xg", 48), "the fastest counterattacks": ("direct_speed_m_s", 48),
    "the longest possessions": ("duration_s", 48), "most progressive": ("progression_m", 48),
    "top 20 counterattacks": (None, 20), "top 500 counterattacks": (None, 96), "first 0": (None, 1),
}


@pytest.fixture(scope="module")
def parsed(spark):
    texts = [*CASES, *DROPPED, *ORDERS, "goals by North Macedonia"]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "text string").selectExpr("text AS request_id", "text")
    teams = spark.createDataFrame([(t,) for t in TEAMS], "team_name string")
    return {r["request_id"]: r for r in R.parse_requests(df, teams).collect()}


def test_filters(parsed):
    for text, want in CASES.items():
        got = {f"{f['field']} {f['op']} {','.join(f['values'])}" for f in parsed[text]["filters"]}
        assert got == want, text


def test_dropped_terms(parsed):
    for text, part in DROPPED.items():
        assert part in "; ".join(parsed[text]["dropped"]), text
    assert parsed["goals by North Macedonia"]["dropped"] == []
    assert parsed["quick vertical attacks"]["dropped"] == []


def test_order_and_limit(parsed):
    for text, (field, limit) in ORDERS.items():
        r = parsed[text]
        assert (r["order_field"], r["limit"]) == (field, limit), text
        assert r["order_dir"] == ("desc" if field else None)


FILTER = "array<struct<field: string, op: string, values: array<string>>>"


def saved(spark, *queries):
    return spark.createDataFrame(
        [(str(i), q, None, None) for i, q in enumerate(queries)],
        f"query_id string, filters {FILTER}, order_field string, order_dir string")


def test_canonical_form(spark):
    mixed = [
        ("counterattack", "neq", ["true"]), ("outcome", "in", ["goal"]), ("n_passes", "gte", ["2.5"]),
        ("n_passes", "lte", ["8"]), ("period", "eq", ["1"]), ("outcome", "neq", ["lost_ball"]), ("xg", "lte", ["0.5"]),
        ("duration_s", "between", ["1", "9"]), ("duration_s", "gte", ["3"]),
    ]
    got = SV.canonicalize(saved(spark, mixed)).first()["filters"]
    assert [tuple(x) for x in got] == [
        ("period", "eq", ["1"]), ("outcome", "neq", ["lost_ball"]), ("counterattack", "eq", ["false"]),
        ("outcome", "eq", ["goal"]), ("duration_s", "between", ["3", "9"]), ("n_passes", "between", ["3", "8"]), ("xg", "lte", ["0.5"])]


def test_identity_ignores_filter_order(spark):
    a, b = ("xg", "gte", ["0.1"]), ("outcome", "eq", ["goal"])
    got = SV.group_by_key(saved(spark, [a, b], [b, a], [a])).orderBy("first_query").collect()
    assert [(r["n_saved"], r["first_query"]) for r in got] == [(2, "0"), (1, "2")]


def test_phrases(spark):
    q = [
        ("xg", "gte", ["0.125"]), ("duration_s", "between", ["2.0", "9.5"]), ("high_press_regain", "eq", ["false"]),
        ("start_zone", "in", ["def_third_left", "def_third_centre", "def_third_right"]),
        ("end_zone", "in", ["def_third_left", "mid_third_left", "final_third_left", "final_third_right"]),
        ("outcome", "in", ["goal", "lost_ball", "foul_won", "out_of_play"]), ("start_type", "eq", ["regular"]), ("minute", "neq", ["5"]),
    ]
    r = SV.describe(saved(spark, q)).first()
    assert r["phrases"] == [
        "xG ≥ 0.13", "Duration 2s–9.5s", "not high turnover", "Start zone: the defensive third",
        "End zone: the left channel or right final third", "Outcome: goal, lost the ball +2 more", "Start type is same-team restart", "Minute is not 5"]
    assert r["order_text"] == "best chance first"
