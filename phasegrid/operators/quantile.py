"""Exact quantiles and rank statistics that spread over many tasks.

``percentile`` keeps every distinct value of a group in one task.  Here equal values are counted
first, then ranked by an ordered scan over slices of a range exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.scan import ordered_scan
from phasegrid.sources import storage


def value_ranks(df: DataFrame, value: str, groups: Sequence[str] = (), **sums: Column) -> DataFrame:
    """Distinct values per group with their count ``n``, running count ``cum`` and total ``n_all``.

    The scan runs over the slices of a range exchange, whose bounds follow the rows, so values that
    crowd into a narrow range are split as well as spread-out ones.  The bounds are sampled, hence
    the written table.  Extra ``sums`` are aggregated per value, with ``cum_<name>`` and
    ``all_<name>``.
    """
    keys = list(groups)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])
        .repartitionByRange(*keys, "v")
        .withColumn("slice", F.spark_partition_id())
    )
    return ordered_scan(
        storage.save(counted, storage.new_path(df.sparkSession, "ranks")),
        keys,
        "v",
        sums={"cum": F.col("n"), **{f"cum_{k}": F.col(k) for k in sums}},
        totals={"n_all": F.col("n"), **{f"all_{k}": F.col(k) for k in sums}},
        block="slice",
    )


def quantiles(
    df: DataFrame,
    value: str,
    points: Mapping[str, float],
    groups: Sequence[str] = (),
    nearest: bool = False,
) -> DataFrame:
    """One row per group: ``n`` and a column per named quantile.

    Interpolates between ranks, or takes the nearest rank (half to even) with ``nearest``.
    """
    ranks = value_ranks(df, value, groups)
    from_rank, to_rank = F.col("cum") - F.col("n"), F.col("cum")

    def at(rank: Column) -> Column:
        return F.max(F.when((from_rank <= rank) & (rank < to_rank), F.col("v")))

    aggs = [F.max("n_all").alias("n")]
    for name, p in points.items():
        place = F.lit(float(p)) * (F.col("n_all") - 1)
        if nearest:
            aggs.append(at(F.bround(place)).alias(name))
        else:
            aggs += [
                at(F.floor(place)).alias(f"_lo_{name}"),
                at(F.ceil(place)).alias(f"_hi_{name}"),
            ]
    out = ranks.groupBy(*groups).agg(*aggs)
    if nearest:
        return out
    for name, p in points.items():
        place = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, lo + (hi - lo) * (place - F.floor(place)))
    return out.select(*groups, "n", *points)


def auc(df: DataFrame, score: str, positive: str, groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with average ranks for ties; NULL where a class is empty."""
    ranks = value_ranks(df, score, groups, pos=F.sum(F.when(F.col(positive), 1).otherwise(0)))
    # Average rank of a tied run: the ranks before it plus half of (its size + 1).
    average = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2
    n_pos, n_all = F.max("all_pos"), F.max("n_all")
    wins = F.sum(F.col("pos") * average) - n_pos * (n_pos + 1) / 2
    pairs = n_pos * (n_all - n_pos)
    return ranks.groupBy(*groups).agg(
        n_pos.alias("n_pos"),
        n_all.alias("n"),
        F.when(pairs > 0, wins / pairs).alias("auc"),
    )
