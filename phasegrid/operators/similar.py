"""Phase vectors and nearest phases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import vectors as V
from phasegrid.sources import snapshots


def moments(phases: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each numeric feature (tiny deviation -> 1)."""
    aggs = []
    for c in K.NUMERIC_FEATURES:
        value = F.col(c).cast("double")
        sd = F.stddev_pop(value)
        aggs += [
            F.avg(value).alias(f"mu_{c}"),
            F.when(sd < 1e-9, F.lit(1.0)).otherwise(sd).alias(f"sd_{c}"),
        ]
    return phases.agg(*aggs)


def fit_moments(phases: DataFrame) -> dict[str, tuple[float, float]]:
    """The 26 numbers of ``moments`` as plan constants (one aggregate row reaches the driver).

    A table without phases, or a column without values, has mean 0 and deviation 1.
    """
    row = moments(phases).first()

    def known(v: float | None, otherwise: float) -> float:
        return otherwise if v is None else v

    return {c: (known(row[f"mu_{c}"], 0.0), known(row[f"sd_{c}"], 1.0)) for c in K.NUMERIC_FEATURES}


def match_moments(phases: DataFrame) -> DataFrame:
    """One row a match: count, mean and squared deviations of each numeric feature.

    These rows merge, so a table of them (``snapshots``) gives the moments of all phases, and
    follows replaced matches by replacing theirs.
    """
    aggs = []
    for c in K.NUMERIC_FEATURES:
        value = F.col(c).cast("double")
        n = F.count(value)
        aggs += [
            n.alias(f"n_{c}"),
            F.coalesce(F.avg(value), F.lit(0.0)).alias(f"mean_{c}"),
            F.coalesce(F.var_pop(value) * n, F.lit(0.0)).alias(f"dev_{c}"),
        ]
    return phases.groupBy("match_id").agg(*aggs)


def merge_moments(per_match: DataFrame) -> dict[str, tuple[float, float]]:
    """What ``fit_moments`` gives for the phases behind rows of ``match_moments``.

    Deviations of a match are moved from its own mean to the mean of all, so nothing cancels.
    """
    def each(of) -> list[Column]:
        return [F.sum(of(c)).cast("double").alias(c) for c in K.NUMERIC_FEATURES]

    n = per_match.agg(*each(lambda c: F.col(f"n_{c}"))).first()
    total = per_match.agg(*each(lambda c: F.col(f"n_{c}") * F.col(f"mean_{c}"))).first()
    mu = {c: total[c] / n[c] if n[c] else 0.0 for c in K.NUMERIC_FEATURES}
    dev = per_match.agg(
        *each(lambda c: F.col(f"dev_{c}") + F.col(f"n_{c}") * F.pow(F.col(f"mean_{c}") - F.lit(mu[c]), F.lit(2)))
    ).first()
    sd = {c: math.sqrt(dev[c] / n[c]) if n[c] else 1.0 for c in K.NUMERIC_FEATURES}
    return {c: (mu[c], sd[c] if sd[c] >= 1e-9 else 1.0) for c in K.NUMERIC_FEATURES}


def refresh_moments(
    spark: SparkSession, path: str, phases: DataFrame, matches: DataFrame | None = None
) -> dict[str, tuple[float, float]]:
    """Moments of all phases after the matches of ``phases`` (and ``matches``) were replaced.

    Only the given phases are read; ``path`` holds the published ``match_moments`` of all matches.
    """
    return merge_moments(snapshots.replace_matches(spark, path, match_moments(phases), matches))


def vector_parts(stats: dict[str, tuple[float, float]]) -> list[str]:
    """The 74 weighted scalars of a row before normalisation, as SQL expressions."""
    parts = []
    for c in K.NUMERIC_FEATURES:
        mu, sd = stats[c]
        z = f"(CAST({c} AS DOUBLE) - {mu!r}D) / {sd!r}D"
        parts.append(f"greatest(least({z}, {K.VECTOR_CLIP}D), -{K.VECTOR_CLIP}D)")
    parts += [f"if({c}, {K.W_BOOL}D, 0D)" for c in K.BOOL_FEATURES]
    for column, domain, weight in (
        ("start_type", K.START_TYPES, K.W_START),
        ("outcome", K.OUTCOMES, K.W_OUTCOME),
        ("start_zone", K.ZONES, K.W_ZONE),
        ("end_zone", K.ZONES, K.W_ZONE),
    ):
        # A NULL label matches nothing and leaves an all-zero block.
        parts += [f"if({column} = '{v}', {weight}D, 0D)" for v in domain]
    for i in K.TRAJECTORY_INDEX:
        x, y = (f"CAST(path_xy[{2 * i + k}] AS DOUBLE)" for k in (0, 1))
        parts += [f"({x} - 60D) / 60D * {K.W_PATH}D", f"({y} - 40D) / 40D * {K.W_PATH}D"]
    return parts


def phase_vectors(rows: DataFrame, stats: dict[str, tuple[float, float]], *keep: str) -> DataFrame:
    """74-dim unit vector per row.  NULL start type or outcome leaves its block at zero.

    Built from scalar columns, not array lambdas, so it stays inside generated code.
    """
    names = [f"_v{i}" for i in range(K.VECTOR_DIM)]
    raw = rows.selectExpr(*keep, *[f"{p} AS {n}" for n, p in zip(names, vector_parts(stats))])
    norm = "sqrt(" + " + ".join(f"{n} * {n}" for n in names) + ")"
    sized = raw.selectExpr("*", f"if({norm} < 1e-9D, 1D, {norm}) AS _norm")
    vec = ", ".join(f"CAST({n} / _norm AS FLOAT)" for n in names)
    return sized.selectExpr(*keep, f"array({vec}) AS vec")


def similar_to(
    vectors: DataFrame,
    target_id,
    k: int = 24,
    id_col: str = "phase_id",
    vec_col: str = "vec",
    digits: int | None = None,
) -> DataFrame:
    """Top ``k`` rows by dot product with one target, self excluded, ties by id.

    The target is one row, so it is broadcast; the top-k runs before any join to wide columns.
    """
    target = vectors.filter(F.col(id_col) == F.lit(target_id)).select(
        F.col(vec_col).alias("_target")
    ).limit(1)
    score = V.dot(F.col(vec_col), F.col("_target"))
    if digits is not None:
        score = F.round(score, digits)
    return (
        vectors.filter(F.col(id_col) != F.lit(target_id))
        .join(F.broadcast(target), F.lit(True))
        .select(id_col, score.alias("score"))
        .orderBy(F.desc("score"), id_col)
        .limit(k)
    )


def similar_phases(similarity: DataFrame, phases: DataFrame, target_id: str, k: int = 24) -> DataFrame:
    """Nearest phases with their columns; the small top-k drives the join."""
    top = similar_to(similarity, target_id, k)
    return top.join(phases, "phase_id").orderBy(F.desc("score"), "phase_id")
