"""Feature rules on hand-built chains; one match per case, all in one job."""

from __future__ import annotations

import pytest

from conftest import event

A, B = (30, 40), (50, 40)


def one_per_case(features, cases):
    """cases: name -> (rows builder, {column: expected}); the last chain of each match is checked."""
    rows, names = [], {}
    for i, (name, (build, _)) in enumerate(cases.items(), start=1):
        names[i] = name
        rows += [dict(r, match_id=i, event_uuid=f"u{i}-{r['index']}") for r in build]
    got = features(rows)
    for i, name in names.items():
        last = got[i][-1]
        for column, want in cases[name][1].items():
            have = last[column]
            ok = have == pytest.approx(want) if isinstance(want, float) else have == want
            assert ok, f"{name}: {column} is {have!r}, expected {want!r}"


def test_start_types(features):
    def one(**k):
        return [event(5, 30, A, B, poss=6, **k)]

    before = [event(1, 30, A, B, poss=5, us=2)]
    cases = {
        f"pattern {p}": (one(play_pattern_id=p), {"start_type": s})
        for p, s in ((9, "kick_off"), (7, "goal_kick"), (2, "corner"), (3, "free_kick"), (4, "throw_in"))
    }
    cases |= {
        "after the other team": (before + one(), {"start_type": "turnover_open_play"}),
        "after the same team": ([event(1, 30, A, B, poss=5)] + one(), {"start_type": "regular"}),
        "first chain": (one(), {"start_type": "regular"}),
        "other period": ([event(1, 30, A, B, poss=5, us=2)] + one(period=2), {"start_type": "regular"}),
        "pass type helps": (one(sub_type_id=63), {"start_type": "goal_kick", "pattern_disagreed": False}),
        "unknown pass type": (before + one(sub_type_id=64), {"start_type": "turnover_open_play"}),
        "disagreement": (one(play_pattern_id=2, sub_type_id=62), {"start_type": "corner", "pattern_disagreed": True}),
        "only the first pass counts": (
            before + one() + [event(6, 30, B, A, poss=6, sub_type_id=67)], {"start_type": "turnover_open_play"}),
    }
    one_per_case(features, cases)


def test_outcomes(features):
    p = event(1, 30, A, B)
    shot = lambda i, o, **k: event(i, 16, (104, 40), (120, 40), outcome_id=o, xg=0.3, **k)
    cases = {
        "goal": ([p, shot(2, 97)], {"outcome": "goal", "xg": 0.3, "n_shots": 1}),
        "saved": ([shot(1, 100)], {"outcome": "shot_on_target"}),
        "saved to post": ([shot(1, 116)], {"outcome": "shot_on_target"}),
        "blocked": ([shot(1, 96)], {"outcome": "shot_off_target"}),
        "post": ([shot(1, 99)], {"outcome": "shot_off_target"}),
        "saved off target": ([shot(1, 115)], {"outcome": "shot_off_target"}),
        "goal before loss": ([shot(1, 97), event(2, 38, (60, 40))], {"outcome": "goal"}),
        "shot before foul": ([shot(1, 100), event(2, 21, (100, 40))], {"outcome": "shot_on_target"}),
        "miscontrol": ([p, event(2, 38, B)], {"outcome": "lost_ball"}),
        "dispossessed": ([p, event(2, 3, B)], {"outcome": "lost_ball"}),
        "error": ([p, event(2, 37, B)], {"outcome": "lost_ball"}),
        "loss before out": ([p, event(2, 38, B, is_out=True)], {"outcome": "lost_ball"}),
        "pass incomplete": ([event(1, 30, A, B, outcome_id=9, is_out=True)], {"outcome": "lost_ball"}),
        "receipt incomplete": ([p, event(2, 42, B, outcome_id=9, is_out=True)], {"outcome": "lost_ball"}),
        "dribble incomplete": ([p, event(2, 14, B, outcome_id=9, is_out=True)], {"outcome": "lost_ball"}),
        "dribble complete": ([p, event(2, 14, B, outcome_id=8, is_out=True)], {"outcome": "out_of_play"}),
        "own foul": ([p, event(2, 22, B, is_out=True)], {"outcome": "lost_ball"}),
        "their interception": ([p, event(2, 10, B, team=2, is_out=True)], {"outcome": "lost_ball"}),
        "dribbled past": ([p, event(2, 39, B, team=2, is_out=True)], {"outcome": "lost_ball"}),
        "their keeper collects": ([p, event(2, 23, B, team=2, sub_type_id=25, is_out=True)], {"outcome": "lost_ball"}),
        "their keeper faces": ([p, event(2, 23, B, team=2, sub_type_id=33, is_out=True)], {"outcome": "out_of_play"}),
        "pass out": ([event(1, 30, A, B, outcome_id=75)], {"outcome": "out_of_play"}),
        "pass offside": ([event(1, 30, A, B, outcome_id=76)], {"outcome": "out_of_play"}),
        "offside": ([p, event(2, 8, B)], {"outcome": "out_of_play"}),
        "injury clearance": ([event(1, 30, A, B, outcome_id=74)], {"outcome": "lost_ball"}),
        "foul won": ([p, event(2, 21, B)], {"outcome": "foul_won"}),
        "their foul": ([p, event(2, 22, B, team=2)], {"outcome": "foul_won"}),
        "period over": ([event(1, 43, A, (40, 40)), event(2, 34)], {"outcome": "end_of_period"}),
        "pressure is not terminal": ([event(1, 21, B), event(2, 17, B, team=2, is_out=True)], {"outcome": "foul_won"}),
        "their own goal": ([p, event(2, 20, (5, 40), team=2)], {"outcome": "goal", "goal_conceded": False}),
        "our own goal": ([p, event(2, 20, (5, 40))], {"outcome": "lost_ball", "goal_conceded": True}),
        "their goal": ([p, shot(2, 97, team=2)], {"outcome": "lost_ball", "goal_conceded": True, "n_shots": 0, "xg": 0.0}),
    }
    one_per_case(features, cases)


def test_geometry_and_clock(features):
    yard = 0.9144
    cases = {
        "only our events": (
            [event(1, 30, A, B), event(2, 17, (104.5, 27.1), team=2), event(3, 43, B, (60, 40))],
            {"start_x": 30.0, "end_x": 60.0, "max_x": 60.0, "pressure_events": 1, "n_passes": 1, "n_events": 3}),
        "backwards": ([event(1, 30, (70, 40), A, ts=0)], {"progression_m": -40 * yard}),
        "speed": (
            [event(1, 30, (20, 40), (40, 40), ts=0, duration=1.0), event(2, 43, (40, 40), (60, 40), ts=3, duration=1.0)],
            {"duration_s": 4.0, "progression_m": 40 * yard, "direct_speed_m_s": 10 * yard}),
        "no time": ([event(1, 2, B, duration=0.0)], {"duration_s": 0.0, "direct_speed_m_s": 0.0, "path_xy": [50.0, 40.0] * 20}),
        "bookkeeping stops the clock": (
            [event(1, 30, A, B, ts=0, duration=1.0), event(2, 40, ts=18, duration=0.0), event(3, 19, ts=371, duration=0.0)],
            {"duration_s": 1.0}),
        "zones": (
            [event(1, 30, (10, 10), (110, 40))],
            {"start_zone": "def_third_left", "end_zone": "final_third_centre", "reached_final_third": True, "reached_box": True}),
        "short of the box": ([event(1, 30, (90, 40), (101, 40))], {"reached_final_third": True, "reached_box": False}),
        "players": (
            [event(1, 30, A, B, player_id=1), event(2, 42, B, player_id=2), event(3, 43, B, A, player_id=1), event(4, 17, B, team=2, player_id=9)],
            {"n_players": 2}),
        "no path": ([event(1, 10, B, team=2)], {"start_x": 60.0, "start_y": 40.0, "path_xy": None, "path_moved": False}),
        "frames": ([event(1, 30, A, B, has_frame=True), event(2, 42, B)], {"frame_coverage": 0.5, "has_360": True}),
    }
    one_per_case(features, cases)


def test_flags(features):
    def turnover(*rows):
        return [event(1, 30, A, B, poss=5, us=2, ts=580)] + [dict(r, possession=6) for r in rows]

    def regain(x=95, **k):
        return event(4, 10, (x, 40), ts=600, outcome_id=16, **k)

    press = event(3, 17, (80, 40), poss=5, us=2, team=1, ts=597)
    win = event(4, 2, (40, 40), ts=0)
    cases = {
        "switch flag": ([event(1, 30, (60, 20), (60, 30), pass_switch=True)], {"switch_of_play": True}),
        "40 yards": ([event(1, 30, (60, 15), (60, 55))], {"switch_of_play": True}),
        "39.9 yards": ([event(1, 30, (60, 15), (60, 54.9))], {"switch_of_play": False}),
        "their long pass": ([event(1, 43, A, B), event(2, 30, (60, 15), (60, 60), team=2)], {"switch_of_play": False}),
        "pressed": (turnover(regain())[:1] + [press] + turnover(regain())[1:], {"high_press_regain": True, "press_before": True}),
        "not pressed": (turnover(regain()), {"high_press_regain": False}),
        "counterpress": (turnover(regain(counterpress=True)), {"high_press_regain": True}),
        "press too early": (turnover(regain())[:1] + [dict(press, ts_s=594.9)] + turnover(regain())[1:], {"press_before": False}),
        "press exactly 5 s before": (turnover(regain())[:1] + [dict(press, ts_s=595.0)] + turnover(regain())[1:], {"press_before": True}),
        "press at the same instant": (turnover(regain())[:1] + [dict(press, ts_s=600.0)] + turnover(regain())[1:], {"press_before": True}),
        "their press": (turnover(regain())[:1] + [dict(press, team_id=2)] + turnover(regain())[1:], {"high_press_regain": False}),
        "too deep": (turnover(regain(79.9, counterpress=True)), {"high_press_regain": False}),
        "set piece": (turnover(regain(counterpress=True, play_pattern_id=2)), {"high_press_regain": False}),
        "fallback is mirrored": (turnover(event(4, 30, (20, 40), B, team=2, counterpress=True)), {"regain_x": 100.1}),
        "later regain counts": (turnover(event(4, 43, A, B), event(5, 2, (90, 40), counterpress=True)), {"regain_x": 90.0, "high_press_regain": True}),
        "counter pattern": ([event(1, 30, A, B, play_pattern_id=6)], {"counterattack": True}),
        "fast break": (turnover(win, event(5, 30, (40, 40), (100, 40), ts=3, duration=1.0)), {"counterattack": True}),
        "slow build-up": (turnover(win, event(5, 30, (40, 40), (100, 40), ts=60, duration=1.0)), {"counterattack": False}),
        "interception lost": (turnover(event(4, 43, A, B), event(5, 10, (90, 40), outcome_id=13)), {"regain_x": 30.0}),
        "failed recovery": (turnover(event(4, 43, A, B), event(5, 2, (90, 40), recovery_failure=True)), {"regain_x": 30.0}),
        "save block": (turnover(event(4, 43, A, B), event(5, 6, (90, 40), save_block=True)), {"regain_x": 30.0}),
        "block": (turnover(event(4, 43, A, B), event(5, 6, (90, 40))), {"regain_x": 90.0}),
        "tackle won": (turnover(event(4, 43, A, B), event(5, 4, (90, 40), sub_type_id=11, outcome_id=16)), {"regain_x": 90.0}),
        "aerial": (turnover(event(4, 43, A, B), event(5, 4, (90, 40), sub_type_id=10, outcome_id=16)), {"regain_x": 30.0}),
        "50/50 won": (turnover(event(4, 43, A, B), event(5, 33, (90, 40), outcome_id=4)), {"regain_x": 90.0}),
        "50/50 lost": (turnover(event(4, 43, A, B), event(5, 33, (90, 40), outcome_id=1)), {"regain_x": 30.0}),
        "keeper collects": (turnover(event(4, 43, A, B), event(5, 23, (3, 40), sub_type_id=27)), {"regain_x": 3.0}),
    }
    one_per_case(features, cases)
