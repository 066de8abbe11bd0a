"""Ordered scans that never put a whole key into one task.

A window over ``match_id`` would sort one match inside one task, whatever its size.  Here every
key is cut into *blocks* of consecutive order values (``order >> BLOCK_BITS``), so a window runs
over at most ``2**BLOCK_BITS`` distinct order values.  One row per block is then aggregated, a
second window over those few rows gives what each block inherits from the blocks before it, and a
join on (key, block) adds that carry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16


def block_of(order: Column, bits: int | None = None) -> Column:
    """Block of an integer order value; ``bits`` defaults to ``BLOCK_BITS``."""
    return F.shiftright(order.cast("long"), BLOCK_BITS if bits is None else bits)


def ordered_scan(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    *,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    block: str | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Add running values over ``order`` within ``key``.

    ``lag`` / ``lead``: value of the previous / next row.  ``sums``: running sum including the row.  ``last``: last
    non-null value up to the row.  ``maxima``: running maximum.  ``totals``: sum over the whole
    key.  ``order`` must be unique within a key.  ``block`` names an existing order-preserving
    block column for orders that are not integers.

    Only blocks that inherit something carry a row, so where every key fits into one block the
    carry is empty and AQE drops the join at run time.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    sums, last = dict(sums or {}), dict(last or {})
    maxima, totals = dict(maxima or {}), dict(totals or {})
    keys = list(key)
    parts = (lag, lead, sums, last, maxima, totals)
    inputs = {f"_in_{n}": c for part in parts for n, c in part.items()}
    bcol = block or "_block"
    src = df if block else df.withColumn("_block", block_of(F.col(order), bits))
    src = src.withColumns(inputs)

    w = Window.partitionBy(*keys, bcol).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)

    def packed(mapping):
        return F.struct(*[F.col(f"_in_{n}").alias(n) for n in mapping])

    local: dict[str, Column] = {}
    if lag:
        local["_lag"] = F.lag(packed(lag)).over(w)
    if lead:
        local["_lead"] = F.lead(packed(lead)).over(w)
    for n in sums:
        local[f"_run_{n}"] = F.sum(f"_in_{n}").over(run)
    for n in last:
        local[f"_run_{n}"] = F.last(f"_in_{n}", ignorenulls=True).over(run)
    for n in maxima:
        local[f"_run_{n}"] = F.max(f"_in_{n}").over(run)
    whole = Window.partitionBy(*keys, bcol)
    for n in totals:
        local[f"_run_{n}"] = F.sum(f"_in_{n}").over(whole)

    aggs = []
    if lag:
        aggs.append(F.max_by(packed(lag), F.col(order)).alias("_edge_lag"))
    if lead:
        aggs.append(F.min_by(packed(lead), F.col(order)).alias("_edge_lead"))
    for n in [*sums, *totals]:
        aggs.append(F.sum(f"_in_{n}").alias(f"_edge_{n}"))
    for n in last:
        held = F.col(f"_in_{n}")
        aggs.append(F.max_by(held, F.when(held.isNotNull(), F.col(order))).alias(f"_edge_{n}"))
    for n in maxima:
        aggs.append(F.max(f"_in_{n}").alias(f"_edge_{n}"))
    edges = src.groupBy(*keys, bcol).agg(*aggs)

    we = Window.partitionBy(*keys).orderBy(bcol)
    before = we.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.col(k) for k in [*keys, bcol]]
    if lag:
        carry.append(F.lag("_edge_lag").over(we).alias("_carry_lag"))
    if lead:
        carry.append(F.lead("_edge_lead").over(we).alias("_carry_lead"))
    for n in sums:
        carry.append(F.sum(f"_edge_{n}").over(before).alias(f"_carry_{n}"))
    for n in last:
        carry.append(F.last(f"_edge_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}"))
    for n in maxima:
        carry.append(F.max(f"_edge_{n}").over(before).alias(f"_carry_{n}"))
    for n in totals:
        carry.append(F.sum(f"_edge_{n}").over(Window.partitionBy(*keys)).alias(f"_carry_{n}"))
    if totals:
        carry.append(F.count("*").over(Window.partitionBy(*keys)).alias("_blocks"))
    carried = edges.select(*carry)
    tests = [F.col(f"_carry_{n}").isNotNull() for n in [*sums, *last, *maxima]]
    if lag:
        tests.append(F.col("_carry_lag").isNotNull())
    if lead:
        tests.append(F.col("_carry_lead").isNotNull())
    if totals:
        tests.append(F.col("_blocks") > 1)
    carried = carried.filter(reduce(or_, tests)).drop("_blocks")

    joined = src.withColumns(local).join(carried, [*keys, bcol], "left")
    out: dict[str, Column] = {}
    if lag:
        both = F.coalesce(F.col("_lag"), F.col("_carry_lag"))
        for n in lag:
            out[n] = both.getField(n)
    if lead:
        both = F.coalesce(F.col("_lead"), F.col("_carry_lead"))
        for n in lead:
            out[n] = both.getField(n)
    for n in sums:
        zero = F.coalesce(F.col(f"_carry_{n}"), F.lit(0))
        out[n] = F.coalesce(F.col(f"_run_{n}"), F.lit(0)) + zero
    for n in last:
        out[n] = F.coalesce(F.col(f"_run_{n}"), F.col(f"_carry_{n}"))
    for n in maxima:
        out[n] = F.greatest(F.col(f"_run_{n}"), F.col(f"_carry_{n}"))
    for n in totals:
        out[n] = F.coalesce(F.col(f"_carry_{n}"), F.col(f"_run_{n}"))
    base = [F.col(c) for c in df.columns if c not in out]
    return joined.select(*base, *[c.alias(n) for n, c in out.items()])


def by_shuffle(side: DataFrame) -> DataFrame:
    """A join side that grows with the events: both sides are shuffled and merged.

    Spark guesses the size of a side from compressed files and a share of their columns, and takes
    a side of hundreds of MB for a few; it would be gathered on the driver to be broadcast.
    """
    return side.hint("merge")


def join_fragments(
    rows: DataFrame, per_key: DataFrame, key: Sequence[str], block: str, size: str | None = None
) -> DataFrame:
    """Add per-key facts to detail rows over (key, block) fragments.

    The detail side joins on keys that hold at most one block of rows each, so one huge key does
    not end up in one task.  Rows whose key has no facts are dropped.  ``size`` names a column of
    ``per_key`` above every order value of the key: the facts are then repeated for each block it
    spans, and the detail rows are read once; otherwise the fragments are counted first.
    """
    if size:
        spread = F.explode(F.sequence(F.lit(0).cast("long"), block_of(F.greatest(F.col(size), F.lit(1)) - 1)))
        return rows.join(by_shuffle(per_key.withColumn(block, spread)), [*key, block])
    fragments = rows.select(*key, block).distinct().join(by_shuffle(per_key), list(key))
    return rows.join(by_shuffle(fragments), [*key, block])
