"""Profiles of the raw feed: coverage, invariants, borders, presence, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions.scan import by_shuffle, ordered_scan
from phasegrid.operators.quantile import quantiles

PRESENCE_FIELDS = (
    "player_id", "x", "duration", "end_x", "outcome_id", "sub_type_id", "xg", "related_events",
)
PRESENCE_FLAGS = ("under_pressure", "counterpress", "is_out")


def coverage_by_match(marked: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame coverage per match, with median and largest number of dots."""
    events = marked.groupBy("match_id").agg(
        F.count("*").alias("events"), F.avg(F.col("has_frame").cast("double")).alias("coverage")
    )
    dots = frames.select("match_id", F.size("freeze_frame").alias("dots"))
    sizes = quantiles(
        dots, "dots", {"median_dots": 0.5, "max_dots": 1.0}, ["match_id"]
    ).withColumnRenamed("n", "frames")
    return events.join(sizes, "match_id", "left")


def coverage_by_type(marked: DataFrame) -> DataFrame:
    return marked.groupBy("type_id").agg(
        F.count("*").alias("events"),
        F.count_if("has_frame").alias("framed"),
        F.avg(F.col("has_frame").cast("double")).alias("coverage"),
    )


def feed_invariants(events: DataFrame) -> DataFrame:
    """Violations per match: index gaps, possession steps, teams per possession."""
    spans = events.groupBy("match_id").agg(
        F.count("*").alias("events"),
        (F.max("index") - F.min("index") + 1 - F.count("*")).alias("index_gaps"),
        F.count_if(F.col("possession") == 0).alias("zero_possessions"),
    )
    steps = ordered_scan(
        events.select("match_id", "index", "possession"),
        ["match_id"],
        "index",
        lag={"before": F.col("possession")},
    )
    step = F.col("possession") - F.col("before")
    moves = steps.groupBy("match_id").agg(
        F.count_if(step < 0).alias("backward_steps"), F.count_if(step > 1).alias("skipped")
    )
    teams = (
        events.select("match_id", "possession", "possession_team_id")
        .distinct()
        .groupBy("match_id", "possession")
        .agg(F.count("*").alias("teams"))
        .groupBy("match_id")
        .agg(
            F.count("*").alias("possessions"),
            F.count_if(F.col("teams") > 1).alias("mixed_possessions"),
        )
    )
    return spans.join(moves, "match_id").join(teams, "match_id")


def chain_borders(chains: DataFrame) -> DataFrame:
    """Terminal event type of a chain by what the next chain of the period does."""
    w = ordered_scan(
        chains.select("match_id", "seq", "period", "team_id", "end_type"),
        ["match_id"],
        "seq",
        lead={"next_team": F.col("team_id"), "next_period": F.col("period")},
    ).filter(F.col("next_period") == F.col("period"))
    stays = F.col("next_team") == F.col("team_id")
    return w.groupBy("end_type").agg(
        F.count_if(~stays).alias("changes"), F.count_if(stays).alias("stays")
    )


def chain_openers(seg: DataFrame) -> DataFrame:
    """First event of a chain by play pattern, type and sub-type."""
    return (
        seg.filter(F.col("idx") == 0)
        .groupBy("play_pattern_id", "type_id", "sub_type_id")
        .agg(F.count("*").alias("n"))
    )


def presence(events: DataFrame) -> DataFrame:
    """Share of each event type that carries each optional field."""
    rates = [F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in PRESENCE_FIELDS]
    rates += [F.avg(F.col(c).cast("double")).alias(c) for c in PRESENCE_FLAGS]
    return events.groupBy("type_id").agg(F.count("*").alias("n"), *rates)


def value_domain(events: DataFrame, column: str) -> DataFrame:
    """Observed values of a sub-object field per event type."""
    return (
        events.filter(F.col(column).isNotNull())
        .groupBy("type_id", F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def related_pairs(events: DataFrame) -> DataFrame:
    """Event joined to each event it names as related."""
    facts = ("type_id", "team_id", "period", "ts_s", "x", "y", "duration")
    left = events.filter(F.col("related_events").isNotNull()).select(
        "match_id",
        "event_uuid",
        F.explode(F.array_distinct("related_events")).alias("other_uuid"),
        *facts,
    )
    right = events.select(
        "match_id",
        F.col("event_uuid").alias("other_uuid"),
        *[F.col(c).alias(f"o_{c}") for c in facts],
    )
    return left.join(by_shuffle(right), ["match_id", "other_uuid"])


def mirrored_pairs(events: DataFrame, within_s: float = 0.0) -> DataFrame:
    """Cross-team related pairs close in time: how far their locations are from mirroring."""
    pairs = related_pairs(events).filter(
        (F.col("team_id") != F.col("o_team_id"))
        & (F.col("period") == F.col("o_period"))
        & (F.abs(F.col("ts_s") - F.col("o_ts_s")) <= within_s)
        & F.col("x").isNotNull()
        & F.col("o_x").isNotNull()
    )
    types = [
        F.least("type_id", "o_type_id").alias("type_a"),
        F.greatest("type_id", "o_type_id").alias("type_b"),
    ]
    gaps = pairs.select(
        *types,
        F.abs(F.col("x") + F.col("o_x") - K.PITCH_X).alias("dx"),
        F.abs(F.col("y") + F.col("o_y") - K.PITCH_Y).alias("dy"),
    )
    by = ["type_a", "type_b"]
    mx = quantiles(gaps, "dx", {"median_dx": 0.5}, by)
    my = quantiles(gaps, "dy", {"median_dy": 0.5}, by).drop("n")
    return mx.join(my, by)


def pressure_overlap(events: DataFrame) -> DataFrame:
    """Related events of a Pressure: inside its duration, before it, or after it."""
    delta = F.col("o_ts_s") - F.col("ts_s")
    pairs = (
        related_pairs(events.filter(F.col("period") != K.SHOOTOUT_PERIOD))
        .filter((F.col("type_id") == K.PRESSURE) & (F.col("period") == F.col("o_period")))
        .select(delta.alias("delta"), F.coalesce("duration", F.lit(0.0)).alias("held"))
    )
    place = (
        F.when(F.col("delta") < 0, "before")
        .when(F.col("delta") <= F.col("held"), "inside")
        .otherwise("after")
    )
    return pairs.groupBy(place.alias("place")).agg(
        F.count("*").alias("n"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta")
    )


def pressure_deltas(events: DataFrame) -> DataFrame:
    """Percentiles of the time between a Pressure and its related events."""
    pairs = related_pairs(events.filter(F.col("period") != K.SHOOTOUT_PERIOD)).filter(
        (F.col("type_id") == K.PRESSURE) & (F.col("period") == F.col("o_period"))
    )
    deltas = pairs.select((F.col("o_ts_s") - F.col("ts_s")).alias("delta"))
    return quantiles(deltas, "delta", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def counterpress_rates(events: DataFrame) -> DataFrame:
    return events.groupBy("type_id").agg(
        F.count("*").alias("n"),
        F.count_if("counterpress").alias("flagged"),
        F.avg(F.col("counterpress").cast("double")).alias("rate"),
    )


def pattern_shares(events: DataFrame) -> DataFrame:
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return events.groupBy("play_pattern_id").agg(F.count("*").alias("n")).withColumn("share", share)


def events_per_match(events: DataFrame) -> DataFrame:
    per = events.groupBy("match_id").agg(F.count("*").alias("events"))
    return quantiles(per, "events", {"min": 0.0, "median": 0.5, "max": 1.0}).withColumnRenamed(
        "n", "matches"
    )


def frame_links(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Orphan frames and event ids with more than one frame."""
    key = ["match_id", "event_uuid"]
    orphans = frames.join(by_shuffle(events.select(*key)), key, "left_anti").agg(
        F.count("*").alias("orphans")
    )
    doubles = (
        frames.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .agg(F.count("*").alias("duplicates"))
    )
    return orphans.join(F.broadcast(doubles), F.lit(True))


def direction_check(events: DataFrame, type_id: int) -> DataFrame:
    """Mean x of one event type by team and period, whatever periods there are."""
    return (
        events.filter((F.col("type_id") == type_id) & F.col("x").isNotNull())
        .groupBy("team_id", "period")
        .agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"))
    )


def turnover_flavours(chains: DataFrame) -> DataFrame:
    """What the previous chain's terminal event says about a turnover."""
    linked = ordered_scan(
        chains.select(
            "match_id", "seq", "period", "team_id", "end_type", "end_outcome",
        ),
        ["match_id"],
        "seq",
        lag={
            "was_team": F.col("team_id"), "was_period": F.col("period"),
            "was_type": F.col("end_type"), "was_outcome": F.col("end_outcome"),
        },
    ).filter(F.col("was_period") == F.col("period"))
    t = F.col("was_type")
    changed = F.col("was_team") != F.col("team_id")
    flavour = (
        F.when(~changed, "same team")
        .when(
            t.isin(K.BALL_RECEIPT, K.PASS) & (F.col("was_outcome") == K.INCOMPLETE),
            "misplaced pass",
        )
        .when(t == K.MISCONTROL, "bad touch")
        .when(t == K.DISPOSSESSED, "tackled off the ball")
        .when((t == K.DRIBBLE) & (F.col("was_outcome") == K.INCOMPLETE), "failed take-on")
        .when(t == K.SHOT, "ended in a shot")
        .when(t.isin(K.BLOCK, K.CLEARANCE), "defensive intervention")
        .otherwise("other")
    )
    return linked.groupBy(flavour.alias("flavour")).agg(F.count("*").alias("n"))
