"""Aggregates behind charts, definition tables and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import geometry as G
from phasegrid.operators.quantile import quantiles


def ended_in_shot() -> Column:
    return F.col("outcome").isin(*K.SHOT_OUTCOMES)


def share_of_total(n: str = "n") -> Column:
    """Share of the grand total, over an already aggregated (small) result."""
    return F.col(n) / F.sum(n).over(Window.partitionBy())


def outcome_mix(phases: DataFrame) -> DataFrame:
    """Outcomes within each start type, largest start type first."""
    mix = phases.groupBy("start_type", "outcome").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("start_type"))
    return (
        mix.withColumn("total", total)
        .select(
            "start_type",
            "outcome",
            G.lookup(F.col("start_type"), K.START_LABELS).alias("start_label"),
            G.lookup(F.col("outcome"), K.OUTCOME_LABELS).alias("outcome_label"),
            "n",
            "total",
            (F.col("n") / F.col("total")).alias("share"),
        )
        .orderBy(F.desc("total"), "start_type", "outcome")
    )


def xg_histogram(phases: DataFrame) -> DataFrame:
    """Shot-ending phases in 0.05 bins (last bin open), scored or not."""
    bin_ = F.least(F.floor(F.col("xg").cast("double") / 0.05) * 0.05, F.lit(0.95))
    return (
        phases.filter(ended_in_shot())
        .groupBy(
            bin_.alias("bin"),
            F.when(F.col("outcome") == "goal", "Scored").otherwise("Did not score").alias("result"),
        )
        .agg(F.count("*").alias("n"))
        .orderBy("bin", "result")
    )


def start_zone_map(phases: DataFrame) -> DataFrame:
    """Starts per third and channel with mean xG and shot rate."""
    return (
        phases.groupBy(
            G.zone_third(F.col("start_zone")).alias("third"),
            G.zone_channel(F.col("start_zone")).alias("channel"),
        )
        .agg(
            F.count("*").alias("n"),
            F.avg(F.col("xg").cast("double")).alias("mean_xg"),
            F.avg(F.when(ended_in_shot(), 1.0).otherwise(0.0)).alias("shot_rate"),
        )
        .withColumns(
            {
                "third_label": G.lookup(F.col("third"), K.THIRD_LABELS),
                "channel_label": G.lookup(F.col("channel"), K.CHANNEL_LABELS),
            }
        )
    )


def duration_progression_grid(phases: DataFrame) -> DataFrame:
    """2-D histogram: 2.5 s by 7.5 m cells, pooled at the rims."""
    dur, prog = F.col("duration_s").cast("double"), F.col("progression_m").cast("double")
    return (
        phases.groupBy(
            F.least(F.floor(dur / 2.5) * 2.5, F.lit(60.0)).alias("dur_bin"),
            F.greatest(
                F.least(F.floor(prog / 7.5) * 7.5, F.lit(97.5)), F.lit(-30.0)
            ).alias("prog_bin"),
        )
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 0)
    )


def turnovers(phases: DataFrame) -> DataFrame:
    return phases.filter(F.col("start_type") == "turnover_open_play")


def regain_deciles(phases: DataFrame) -> DataFrame:
    """Where turnover phases start along the pitch."""
    points = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    return quantiles(turnovers(phases), "start_x", points)


def regain_bands(phases: DataFrame) -> DataFrame:
    x = F.col("start_x")
    band = (
        F.when(x >= 80, "final third (x>=80)").when(x >= 40, "middle third").otherwise("own third")
    )
    return (
        turnovers(phases)
        .groupBy(band.alias("band"))
        .agg(F.count("*").alias("n"))
        .withColumn("pct", F.lit(100.0) * share_of_total())
    )


def regain_value(phases: DataFrame) -> DataFrame:
    band = F.when(F.col("start_x") >= 80, "final third").otherwise("rest")
    return (
        turnovers(phases)
        .groupBy(band.alias("band"))
        .agg(
            F.count("*").alias("n"),
            (F.lit(100.0) * F.count_if(ended_in_shot()) / F.count("*")).alias("shot_pct"),
            F.avg(F.col("xg").cast("double")).alias("mean_xg"),
        )
    )


def flag_totals(phases: DataFrame) -> DataFrame:
    flags = ("high_press_regain", "counterattack", "switch_of_play", "reached_box")
    return phases.agg(
        F.count("*").alias("phases"), *[F.sum(F.col(c).cast("long")).alias(c) for c in flags]
    )


def switch_distances(events: DataFrame) -> DataFrame:
    """Lateral distance of every located pass outside the shoot-out, flagged switch or not."""
    return events.filter(
        (F.col("type_id") == K.PASS)
        & (F.col("period") != K.SHOOTOUT_PERIOD)
        & F.col("y").isNotNull()
        & F.col("end_y").isNotNull()
    ).select("pass_switch", F.abs(F.col("end_y") - F.col("y")).alias("dy"))


def switch_distance_stats(events: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of the lateral distance by flag."""
    d = switch_distances(events)
    points = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    stats = quantiles(d, "dy", points, ["pass_switch"], nearest=True)
    ends = d.groupBy("pass_switch").agg(F.min("dy").alias("min_dy"), F.max("dy").alias("max_dy"))
    return stats.join(ends, "pass_switch")


def switch_thresholds(events: DataFrame, cuts=(30, 35, 40, 45)) -> DataFrame:
    """Per cut-off: unflagged passes that would qualify, flagged ones that would not."""
    cut = F.explode(F.array(*[F.lit(int(c)) for c in cuts])).alias("cut")
    return (
        switch_distances(events)
        .select("pass_switch", "dy", cut)
        .groupBy("cut")
        .agg(
            F.count_if(~F.col("pass_switch") & (F.col("dy") >= F.col("cut"))).alias("extra"),
            F.count_if(F.col("pass_switch") & (F.col("dy") < F.col("cut"))).alias("missed"),
            F.count_if("pass_switch").alias("flagged"),
        )
    )


def counter_measures(chains: DataFrame) -> DataFrame:
    """Long form of speed, progression (yards) and duration of chains whose path moves."""
    yards = F.col("end_x") - F.col("start_x")
    return chains.filter("path_moved").select(
        F.when(F.col("play_pattern_id") == K.PATTERN_COUNTER, "counter")
        .otherwise("other")
        .alias("kind"),
        F.col("speed_yd").alias("speed"),
        yards.alias("prog"),
        F.col("duration_s").alias("dur"),
    ).unpivot("kind", ["speed", "prog", "dur"], "measure", "value")


def counter_stats(chains: DataFrame) -> DataFrame:
    """Nearest-rank percentiles and means of tagged counters against the rest."""
    long = counter_measures(chains)
    points = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    stats = quantiles(long, "value", points, ["kind", "measure"], nearest=True)
    means = long.groupBy("kind", "measure").agg(F.avg("value").alias("mean"))
    shares = F.col("n") / F.sum("n").over(Window.partitionBy("measure"))
    return stats.join(means, ["kind", "measure"]).withColumn("share", shares)


def speed_sweep(chains: DataFrame, thr: K.Thresholds = K.Thresholds(), cuts=(3.0, 4.3, 5.5, 6.9)) -> DataFrame:
    """Geometric counter-attacks per speed cut-off: count, share, shot rate, mean xG."""
    yards = F.col("end_x") - F.col("start_x")
    rest = (
        (F.col("start_type") == "turnover_open_play")
        & (F.col("regain_x") <= thr.counter_regain_x_max)
        & (yards >= thr.counter_progression)
        & F.col("reached_final_third")
    )
    rows = chains.select(
        F.coalesce(rest, F.lit(False)).alias("rest"), "speed_yd", "xg", ended_in_shot().alias("shot"),
        F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut"),
    )
    hit = F.col("rest") & (F.col("speed_yd") >= F.col("cut"))
    return rows.groupBy("cut").agg(
        F.count_if(hit).alias("n"),
        (F.count_if(hit) / F.count("*")).alias("share"),
        F.avg(F.when(hit, F.col("shot").cast("double"))).alias("shot_rate"),
        F.avg(F.when(hit, F.col("xg"))).alias("mean_xg"),
    )


def start_type_shares(phases: DataFrame) -> DataFrame:
    return (
        phases.groupBy("start_type").agg(F.count("*").alias("n")).withColumn("share", share_of_total())
    )


def outcome_shares(phases: DataFrame) -> DataFrame:
    return (
        phases.groupBy("outcome")
        .agg(F.count("*").alias("n"), F.avg(F.col("xg").cast("double")).alias("mean_xg"))
        .withColumn("share", share_of_total())
    )


def competition_counts(phases: DataFrame) -> DataFrame:
    return phases.groupBy("competition").agg(F.count("*").alias("n"))


def mean_canonical_x(phase_events: DataFrame) -> DataFrame:
    """Keeper and shot events by side: shows that the frames were rotated."""
    return (
        phase_events.filter(F.col("type_id").isin(K.GOALKEEPER, K.SHOT))
        .groupBy("type_id", "team_side")
        .agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("mean_x"))
    )


def phases_per_match(phases: DataFrame) -> DataFrame:
    per = phases.groupBy("match_id").agg(F.count("*").alias("phases"))
    return quantiles(per, "phases", {"min": 0.0, "median": 0.5, "max": 1.0}).withColumnRenamed(
        "n", "matches"
    )


def goal_counts(events: DataFrame) -> DataFrame:
    """Raw goals per match outside the shoot-out."""
    played = F.col("period") != K.SHOOTOUT_PERIOD
    return events.groupBy("match_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(
            played & (F.col("type_id") == K.SHOT) & (F.col("outcome_id") == K.SHOT_GOAL)
        ).alias("goal_shots"),
        F.count_if(played & (F.col("type_id") == K.OWN_GOAL_AGAINST)).alias("own_goals"),
    )


def group_sizes(phase_events: DataFrame) -> DataFrame:
    return phase_events.groupBy("phase_id").agg(F.count("*").alias("n"))


PUBLISHED = ("matches", "phases", "phase_events", "phase_frames", "similarity")


def stored_manifest(tables) -> DataFrame:
    """The manifest that the build wrote beside its tables."""
    spark = tables.phases.sparkSession
    return spark.read.schema("item string, value long").parquet(f"{tables.path}/manifest")


def manifest(tables) -> DataFrame:
    """What a build has written, as (item, value) rows: row counts, goals, frame orientations, and
    the files, bytes and bucket folders of each table."""
    t = tables

    def count(df: DataFrame, item: str) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(item).alias("item"), "value")

    goals = goal_counts(t.events).agg(
        F.sum("goal_shots").alias("goal_shots"), F.sum("own_goals").alias("own_goals")
    ).unpivot([], ["goal_shots", "own_goals"], "item", "value")
    orient = t.phase_frames.groupBy(
        F.concat(F.lit("orientation_"), F.col("orientation")).alias("item")
    ).agg(F.count("*").alias("value"))
    out = goals.unionByName(orient)
    for item in PUBLISHED:
        out = out.unionByName(count(getattr(t, item), item))
        out = out.unionByName(
            table_bytes(t.phases.sparkSession, f"{t.path}/{item}").unpivot(
                [], ["files", "bytes", "shards"], "kind", "value"
            ).select(F.concat_ws("_", "kind", F.lit(item)).alias("item"), "value")
        )
    return out.unionByName(count(t.events, "raw_events")).unionByName(
        count(t.frames, "raw_frames")
    )


def table_bytes(spark, path: str) -> DataFrame:
    """Files, bytes and folders of a written table (names and lengths only)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .agg(
            F.count("*").alias("files"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
            F.count_distinct(F.regexp_extract("path", "/bucket=([0-9]+)/", 1)).alias("shards"),
        )
    )
