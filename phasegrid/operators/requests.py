"""Search requests in plain words -> filters, as expressions over a text column.

Nothing is guessed: what the language cannot express is listed as dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions.scan import by_shuffle

# Word boundary of ASCII word characters.
# ASCII word borders, spelled out because \b follows the Unicode rules of the Java version.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_SPACES = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"

# Phrases of the request vocabulary.
PHRASES = {
    "high_press": (
        "high turnover", "high press", "high-press", "won it high", "winning it high",
        "high regain", "press high",
    ),
    "counter": ("counter", "on the break", "transition"),
    "switch": ("switch", "changed the point of attack", "change the point of attack"),
    "goal_kick_words": ("goal kick", "goal-kick"),
    "shot": ("shot",),
    "box": ("box", "penalty area", "penalty box", "eighteen-yard", "18-yard"),
    "final_third": ("final third", "attacking third", "last third"),
    "long": (
        "long possession", "sustained", "patient", "long build-up", "long buildup",
    ),
    "quick": ("quick", "fast", "direct", "vertical", "rapid"),
    "chance": ("big chance", "good chance", "clear chance", "great chance", "best chances"),
    "pressure": ("under pressure", "pressed", "pressing", "while pressed"),
    "framed": ("360", "freeze frame", "freeze-frame"),
    "wide": ("wide", "from the flank", "out wide"),
    "central": ("central", "centrally", "through the middle"),
}
START_PHRASES = (
    ("corner", ("corner",)),
    ("free_kick", ("free kick", "free-kick", "freekick")),
    ("throw_in", ("throw in", "throw-in", "throwin")),
    (
        "goal_kick",
        ("goal kick", "goal-kick", "build-up from the back", "build up from the back",
         "from the back", "playing out from the back"),
    ),
    ("kick_off", ("kick off", "kick-off", "kickoff")),
    ("turnover_open_play", ("turnover", "won the ball back", "regain")),
)
ORDER_PHRASES = (
    ("xg", ("best", "highest xg", "biggest chance", "best chances", "highest-xg")),
    ("direct_speed_m_s", ("fastest", "most direct", "quickest")),
    ("duration_s", ("longest", "slowest")),
    ("progression_m", ("most progressive", "furthest")),
)
COMPETITION_PHRASES = (
    ("Euro 2024", ("euro 2024", "euros 2024", "2024")),
    ("Euro 2020", ("euro 2020", "euros 2020", "2020", "euro 2021")),
)
# What the phase table cannot answer.
UNSUPPORTED = (
    ("opponent (the index filters the team in possession only)",
     rf"{_B}against{_E}|{_B}vs{_E}|{_B}versus{_E}|{_B}opponent"),
    ("date or round (not a DSL field)",
     rf"{_B}(19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}{_E}|{_B}june{_E}|{_B}july{_E}"
     rf"|{_B}match ?day{_E}|{_B}the final{_E}|{_B}semi-?final{_E}|{_B}quarter-?final{_E}"
     rf"|{_B}group stage{_E}|{_B}round of 16{_E}"),
    ("scoreline or game state (not a DSL field)",
     rf"{_B}[0-9]\s*-\s*[0-9]{_E}|{_B}scoreline{_E}|{_B}winning{_E}|{_B}losing{_E}"
     rf"|{_B}drawing{_E}|{_B}leading{_E}|{_B}behind{_E}"),
    ("event-level action (phases are searched by their summary features)",
     rf"{_B}assist|{_B}dribble|{_B}beat (two|three|a|the) defender|{_B}header|{_B}nutmeg"
     rf"|{_B}cross(es|ed)?{_E}|{_B}tackle"),
    ("role (no player or role columns in the index)",
     rf"{_B}keeper{_E}|{_B}goalkeeper{_E}|{_B}manager{_E}|{_B}coach{_E}"),
)
# Patterns of a person's name and of a named starting zone.
_PLAYER = (
    rf"{_B}(?:by|from|for)\s+([A-Z][a-zà-ÿ'’-]+(?:\s+[A-Z][a-zà-ÿ'’-]+)+)"
)
_ZONE = (
    rf"{_B}(?:start(?:ing|s|ed)?|beginning|begin|originating|from){_E}[^.]{{0,24}}?"
    rf"{_B}(defensive|own|middle|final|attacking){_E}[^.]{{0,12}}?third"
)
_STARTING_FINAL = rf"{_B}(start(ing|s|ed)?|beginning|begin|from){_E}[^.]{{0,20}}final third"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _has(*needles: str) -> str:
    return "(" + " OR ".join(f"contains(t, {_sql(n)})" for n in needles) + ")"


def _number_after(cues) -> str:
    """First cue, in the given order, that is followed by a number."""
    found = [
        f"nullif(regexp_extract(t, {_sql(cue + r'\s+([0-9]+(?:\.[0-9]+)?)')}, 1), '')"
        for cue in cues
    ]
    return f"coalesce({', '.join(found)})"


def _slot(field: str, op: str, *branches: tuple[str, str]) -> str:
    """A filter whose value comes from the first branch that applies."""
    cases = " ".join(f"WHEN {cond} THEN {values}" for cond, values in branches)
    return (
        f"CASE WHEN {' OR '.join('(' + c + ')' for c, _ in branches)} THEN"
        f" named_struct('field', '{field}', 'op', '{op}', 'values', CASE {cases} END) END"
    )


def _values(*texts: str) -> str:
    return "array(" + ", ".join(_sql(t) for t in texts) + ")"


def normalize(text):
    """Lower case, plain dashes and quotes, single spaces."""
    low = F.regexp_replace(F.lower(text), "[‐-―]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[‘’]", "'"), _SPACES, " "))


def match_teams(requests: DataFrame, teams: DataFrame) -> DataFrame:
    """Earliest team named before any opponent marker; at equal places the longest name.

    ``requests`` holds request_id and normalised text ``t``; ``teams`` one column ``team_name``.
    All word-bounded substrings as long as some team name are matched by equality, so requests
    and names meet in a hash join, never pairwise.
    """
    names = teams.select("team_name", F.lower("team_name").alias("key")).distinct()
    # Distinct name lengths: at most as many as the longest name has letters.
    lengths = sorted(
        r[0] for r in names.filter("key <> ''").select(F.length("key")).distinct().collect()
    )
    if not lengths:
        return requests.select("request_id", F.lit(None).cast("string").alias("team_name")).limit(0)
    space = F.regexp_replace("t", rf"(?s){_B}(against|vs|versus){_E}.*$", "")
    windows = F.flatten(
        F.array(
            *[
                F.regexp_extract_all(
                    "space", F.lit(rf"(?s)(?=(?<![a-z])(.{{{n}}})(?![a-z]))"), 1
                )
                for n in lengths
            ]
        )
    )
    found = (
        requests.select("request_id", space.alias("space"))
        .select("request_id", "space", F.explode(F.array_distinct(windows)).alias("key"))
        .join(by_shuffle(names), "key")
        .withColumn("place", F.expr("locate(key, space)"))
    )
    best = F.min_by("team_name", F.struct("place", -F.length("key"), F.col("team_name")))
    return found.groupBy("request_id").agg(best.alias("team_name"))


def parse_requests(requests: DataFrame, teams: DataFrame, competitions=COMPETITION_PHRASES) -> DataFrame:
    """``request_id, text`` -> filters, order, limit and dropped terms."""
    P = PHRASES
    base = requests.select(
        "request_id",
        F.trim("text").alias("raw"),
        normalize(F.col("text")).alias("t"),
    )
    facts = base.selectExpr(
        "*",
        f"{_number_after(['under', 'less than', 'shorter than', 'within', 'inside'])} AS under_s",
        f"{_number_after(['over', 'more than', 'longer than', 'at least', 'above'])} AS over_s",
        f"coalesce({_number_after(['at least', 'minimum of', 'more than'])},"
        f" nullif(regexp_extract(t, {_sql(r'([0-9]+)\s*\+\s*pass')}, 1), '')) AS passes",
        f"{_number_after(['top', 'first', 'show me', 'give me'])} AS top_n",
        f"nullif(regexp_extract(t, {_sql(_ZONE)}, 1), '') AS zone_word",
        f"{_has(*P['high_press'])} AS high",
        f"(t rlike {_sql(r'(^|[^a-z])goals?([^a-z]|$)')} AND NOT {_has(*P['goal_kick_words'])})"
        " AS goal",
        f"nullif(regexp_extract(raw, {_sql(_PLAYER)}, 1), '') AS person",
    )
    third = (
        "CASE WHEN zone_word IN ('defensive', 'own') THEN 'def_third'"
        " WHEN zone_word = 'middle' THEN 'mid_third' ELSE 'final_third' END"
    )

    def zones(channels) -> str:
        return "array(" + ", ".join(f"concat({third}, '_{c}')" for c in channels) + ")"

    starts = []
    for value, needles in START_PHRASES:
        cond = _has(*needles)
        if value == "turnover_open_play":
            # A high turnover already says so.
            cond = f"{cond} AND NOT high"
        starts.append((cond, _values(value)))
    number = "array(CAST(CAST({} AS DOUBLE) AS STRING))"
    in_seconds, in_passes = _has("second"), _has("pass")
    slots = [
        _slot("high_press_regain", "eq", ("high", _values("true"))),
        _slot("counterattack", "eq", (_has(*P["counter"]), _values("true"))),
        _slot("switch_of_play", "eq", (_has(*P["switch"]), _values("true"))),
        _slot("outcome", "eq", ("goal", _values("goal"))),
        _slot("outcome", "in", (f"NOT goal AND {_has(*P['shot'])}", _values(*K.SHOT_OUTCOMES))),
        _slot("reached_box", "eq", (_has(*P["box"]), _values("true"))),
        _slot(
            "reached_final_third", "eq",
            (f"{_has(*P['final_third'])} AND NOT t rlike {_sql(_STARTING_FINAL)}", _values("true")),
        ),
        # The explicit number comes last in the text rules, so it wins over the phrase.
        _slot(
            "duration_s", "gte",
            (f"over_s IS NOT NULL AND {in_seconds}", number.format("over_s")),
            (_has(*P["long"]), _values("20.0")),
        ),
        _slot(
            "n_passes", "gte",
            (f"passes IS NOT NULL AND {in_passes}", number.format("passes")),
            (_has(*P["long"]), _values("8.0")),
        ),
        _slot("direct_speed_m_s", "gte", (_has(*P["quick"]), _values("3.0"))),
        _slot(
            "duration_s", "lte",
            (f"under_s IS NOT NULL AND {in_seconds}", number.format("under_s")),
        ),
        _slot("start_type", "eq", *starts),
        _slot("xg", "gte", (_has(*P["chance"]), _values("0.1"))),
        _slot("pressure_events", "gte", (_has(*P["pressure"]), _values("1.0"))),
        _slot("has_360", "eq", (_has(*P["framed"]), _values("true"))),
        _slot(
            "start_zone", "in",
            (f"zone_word IS NOT NULL AND {_has(*P['wide'])}", zones(("left", "right"))),
            (f"zone_word IS NOT NULL AND {_has(*P['central'])}", zones(("centre",))),
            ("zone_word IS NOT NULL", zones(K.CHANNELS)),
        ),
        _slot("team_name", "eq", ("team_name IS NOT NULL", "array(team_name)")),
        _slot("competition", "eq", *[(_has(*n), _values(c)) for c, n in competitions]),
    ]
    order = " ".join(f"WHEN {_has(*n)} THEN '{f}'" for f, n in ORDER_PHRASES)
    dropped = [f"CASE WHEN t rlike {_sql(rx)} THEN {_sql(label)} END" for label, rx in UNSUPPORTED]
    dropped.append(
        "CASE WHEN person IS NOT NULL AND known_key IS NULL THEN"
        " concat('\"', person, '\" (no player names in the phase index)') END"
    )
    known = teams.select(F.lower("team_name").alias("known_key")).distinct()
    named = facts.join(by_shuffle(match_teams(base, teams)), "request_id", "left").join(
        known, F.lower("person") == F.col("known_key"), "left"
    )
    return named.selectExpr(
        "request_id",
        f"array_compact(array({', '.join(slots)})) AS filters",
        f"CASE {order} END AS order_field",
        f"CASE WHEN {' OR '.join(_has(*n) for _, n in ORDER_PHRASES)} THEN 'desc' END AS order_dir",
        "CAST(CASE WHEN top_n IS NULL THEN 48"
        " ELSE least(greatest(floor(CAST(top_n AS DOUBLE)), 1), 96) END AS INT) AS limit",
        f"array_compact(array({', '.join(dropped)})) AS dropped",
    )


def matched_filters(parsed: DataFrame) -> DataFrame:
    """One row per extracted filter."""
    return parsed.select("request_id", F.explode("filters").alias("f")).select(
        "request_id", "f.field", "f.op", F.array_join("f.values", ",").alias("values")
    )
