"""Ids, enums, geometry and thresholds the results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Event type id -> name of the public match-event feed.
EVENT_TYPES: dict[int, str] = {
    2: "Ball Recovery", 3: "Dispossessed", 4: "Duel", 6: "Block", 8: "Offside",
    9: "Clearance", 10: "Interception", 14: "Dribble", 16: "Shot", 17: "Pressure",
    18: "Half Start", 19: "Substitution", 20: "Own Goal Against", 21: "Foul Won",
    22: "Foul Committed", 23: "Goal Keeper", 24: "Bad Behaviour", 25: "Own Goal For",
    26: "Player On", 27: "Player Off", 28: "Shield", 30: "Pass", 33: "50/50",
    34: "Half End", 35: "Starting XI", 36: "Tactical Shift", 37: "Error",
    38: "Miscontrol", 39: "Dribbled Past", 40: "Injury Stoppage",
    41: "Referee Ball-Drop", 42: "Ball Receipt*", 43: "Carry",
}

BALL_RECOVERY, DISPOSSESSED, DUEL, BLOCK, OFFSIDE, CLEARANCE = 2, 3, 4, 6, 8, 9
INTERCEPTION, DRIBBLE, SHOT, PRESSURE, HALF_START = 10, 14, 16, 17, 18
OWN_GOAL_AGAINST, FOUL_WON, FOUL_COMMITTED, GOALKEEPER = 20, 21, 22, 23
PASS, FIFTY_FIFTY, HALF_END, ERROR, MISCONTROL = 30, 33, 34, 37, 38
DRIBBLED_PAST, BALL_RECEIPT, CARRY = 39, 42, 43

# Types without a ball position (bookkeeping only).
ADMIN_TYPES = (18, 19, 24, 26, 27, 34, 35, 36, 40)

# Key of the type-specific sub-object in the raw JSON.
SUB_OBJECTS: dict[int, str] = {
    2: "ball_recovery", 4: "duel", 6: "block", 9: "clearance", 10: "interception",
    14: "dribble", 16: "shot", 19: "substitution", 21: "foul_won",
    22: "foul_committed", 23: "goalkeeper", 24: "bad_behaviour", 30: "pass",
    33: "50_50", 38: "miscontrol", 40: "injury_stoppage", 42: "ball_receipt", 43: "carry",
}
END_LOCATION_TYPES = (PASS, CARRY, SHOT, GOALKEEPER)
XG_FIELD = "statsbomb_xg"  # field name inside the raw shot object

# Order of the event-type vocabulary (1-based; 0 = unknown).
TYPE_VOCABULARY = (
    2, 3, 4, 6, 8, 9, 10, 14, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28,
    30, 33, 34, 36, 37, 38, 39, 40, 41, 42, 43, 35,
)

# Play pattern id / pass type id -> how a phase starts.
PATTERN_COUNTER = 6
PATTERN_START = {2: "corner", 3: "free_kick", 4: "throw_in", 7: "goal_kick", 9: "kick_off"}
PASS_TYPE_START = {61: "corner", 62: "free_kick", 63: "goal_kick", 65: "kick_off", 67: "throw_in"}

# Outcome ids.
INCOMPLETE, PASS_OUT, PASS_OFFSIDE, PASS_UNKNOWN = 9, 75, 76, 77
SHOT_GOAL = 97
SHOT_ON_TARGET = (100, 116)
WON_OUTCOMES = (4, 15, 16, 17)
TACKLE = 11
FIFTY_FIFTY_WON = (3, 4)
KEEPER_REGAIN_TYPES = (25, 27, 34)

# Enums, stages and their order.
START_TYPES = (
    "kick_off", "goal_kick", "corner", "free_kick", "throw_in", "turnover_open_play", "regular",
)
OUTCOMES = (
    "goal", "shot_on_target", "shot_off_target", "lost_ball", "out_of_play", "foul_won",
    "end_of_period",
)
SHOT_OUTCOMES = ("goal", "shot_on_target", "shot_off_target")
THIRDS = ("def_third", "mid_third", "final_third")
CHANNELS = ("left", "centre", "right")
ZONES = tuple(f"{t}_{c}" for t in THIRDS for c in CHANNELS)
COMPETITIONS = ("Euro 2020", "Euro 2024")
TEAM_SIDES = ("in_possession", "opponent")
ORIENTATIONS = ("event", "mirrored", "unknown")
STAGES = {
    10: "Group Stage", 33: "Round of 16", 11: "Quarter-final", 15: "Semi-final", 26: "Final",
    25: "3rd Place Final",
}

# Display labels.
START_LABELS = {
    "kick_off": "Kick-off", "goal_kick": "Goal kick", "corner": "Corner",
    "free_kick": "Free kick", "throw_in": "Throw-in",
    "turnover_open_play": "Open-play turnover", "regular": "Same-team restart",
}
OUTCOME_LABELS = {
    "goal": "Goal", "shot_on_target": "Shot on target", "shot_off_target": "Shot off target",
    "lost_ball": "Lost the ball", "out_of_play": "Out of play", "foul_won": "Foul won",
    "end_of_period": "End of period",
}
THIRD_LABELS = {"def_third": "Defensive", "mid_third": "Middle", "final_third": "Final"}
CHANNEL_LABELS = {"left": "Left", "centre": "Centre", "right": "Right"}

# Pitch geometry.
PITCH_X, PITCH_Y = 120.0, 80.0
# Margin drawn around the pitch.
PITCH_PAD = 4.0
EVENT_MIRROR_X, EVENT_MIRROR_Y = 120.1, 80.1
MIDDLE_THIRD_X, FINAL_THIRD_X = 40.0, 80.0
CHANNEL_1, CHANNEL_2 = 80.0 / 3.0, 160.0 / 3.0
BOX_X_MIN, BOX_Y_MIN, BOX_Y_MAX = 102.0, 18.0, 62.0
YARD_M = 0.9144
PERIOD_OFFSET_S = {1: 0.0, 2: 2700.0, 3: 5400.0, 4: 6300.0, 5: 7200.0}
SHOOTOUT_PERIOD = 5
PATH_POINTS = 20
ACTOR_TOLERANCE = 1.5
PAIRED_EPS = 1e-4
MIN_FRAME_FILE_BYTES = 50_000

# Layout and weights of the 74-dim phase vector.
NUMERIC_FEATURES = (
    "duration_s", "n_passes", "n_events", "n_players", "progression_m", "direct_speed_m_s",
    "pressure_events", "xg", "start_x", "start_y", "end_x", "end_y", "max_x",
)
BOOL_FEATURES = (
    "high_press_regain", "counterattack", "switch_of_play", "reached_final_third", "reached_box",
)
# 20 path points thinned to 12 (rounded even spacing), clip, weights, size.
TRAJECTORY_INDEX = (0, 2, 3, 5, 7, 9, 10, 12, 14, 16, 17, 19)
VECTOR_CLIP = 3.0
W_BOOL, W_START, W_OUTCOME, W_ZONE, W_PATH = 0.8, 0.7, 0.7, 0.6, 0.5
VECTOR_DIM = 74

# Channels of an event and labels of the probe, in order.
EVENT_CHANNELS = (
    "x", "y", "has_loc", "end_x", "end_y", "has_end", "dx", "dy", "t_rel", "dt",
    "under_pressure", "counterpress", "out", "xg", "side",
)
PROBE_LABELS = ("cross", "through_ball", "high_pass", "head_pass", "aerial_won")


@dataclass(frozen=True)
class Thresholds:
    """Tunable numbers of the feature layer (yards and seconds)."""

    high_press_x: float = 80.0
    high_press_window_s: float = 5.0
    switch_dy: float = 40.0
    counter_regain_x_max: float = 60.0
    counter_speed: float = 4.3
    counter_progression: float = 18.0
