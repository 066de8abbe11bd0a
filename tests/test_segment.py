"""Chains: borders, stubs, numbering, and runs that cross block borders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import event, frame_of
from phasegrid.functions import scan
from phasegrid.operators import features as X
from phasegrid.operators.segment import CHAIN, segment
from phasegrid.plans import build, profiling


def chains(spark, rows):
    seg = segment(frame_of(spark, rows))
    return [
        (r.match_id, r.period, r.possession, r.team_id, r.n_events, r.play_pattern_id)
        for r in X.aggregate_chains(seg).orderBy("match_id", "start_index").collect()
    ]


def test_chain_borders(spark):
    a, b, c = (30, 40), (50, 40), (70, 40)
    rows = [
        # 1: a new possession number starts a chain
        event(1, 30, a, b), event(2, 30, b, c), event(3, 30, (40, 40), (60, 40), poss=3, us=2),
        # 2: a possession number that runs through half-time; the second half's stub goes
        event(1, 30, a, b, match=2, poss=66, us=2), event(2, 34, match=2, poss=66, us=2, ts=2913),
        event(3, 34, match=2, poss=66, us=2, team=1, ts=2913),
        event(4, 18, match=2, period=2, poss=66, us=2, ts=0), event(5, 18, match=2, period=2, poss=66, us=2, ts=0),
        event(6, 30, (61, 40), b, match=2, period=2, poss=67),
        # 3: only bookkeeping in the first possession
        event(1, 35, match=3, poss=1, ts=0), event(2, 18, match=3, poss=1, ts=0), event(3, 30, a, b, match=3),
        # 4: a restart for the same team stays apart
        event(1, 30, a, b, match=4, poss=10), event(2, 21, (52, 40), match=4, poss=10), event(3, 30, (52, 40), c, match=4, poss=11),
        # 5: no shoot-out
        event(1, 30, a, b, match=5, period=4, poss=170), event(2, 16, (108, 40), match=5, period=5, poss=171, outcome_id=97, xg=0.8),
        # 6: nothing located
        event(1, 19, match=6, poss=40), event(2, 36, match=6, poss=40), event(3, 43, a, (40, 40), match=6, poss=41),
        # 7: opponents stay inside; the last play pattern counts
        event(1, 30, a, b, match=7), event(2, 17, (104, 27), match=7, team=2), event(3, 30, b, c, match=7, play_pattern_id=6),
        # 8: a possession number that comes back later is a new run
        event(1, 30, a, b, match=8, poss=5), event(2, 30, a, b, match=8, poss=6, us=2), event(3, 30, a, b, match=8, poss=5),
    ]
    assert chains(spark, rows) == [
        (1, 1, 2, 1, 2, 1), (1, 1, 3, 2, 1, 1),
        (2, 1, 66, 2, 3, 1), (2, 2, 67, 1, 1, 1),
        (3, 1, 2, 1, 1, 1),
        (4, 1, 10, 1, 2, 1), (4, 1, 11, 1, 1, 1),
        (5, 4, 170, 1, 1, 1),
        (6, 1, 41, 1, 1, 1),
        (7, 1, 2, 1, 3, 6),
        (8, 1, 5, 1, 1, 1), (8, 1, 6, 2, 1, 1), (8, 1, 5, 1, 1, 1),
    ]


def long_match(n=90):
    """Runs of 1 to 17 events; some possessions are bookkeeping only."""
    rows, poss, left = [], 1, 3
    for i in range(1, n + 1):
        if left == 0:
            poss, left = poss + 1, 1 + (poss * 7) % 17
        left -= 1
        stub = poss % 5 == 0
        us = poss % 2
        rows.append(
            event(
                i * 3, 19 if stub else (30 if i % 3 else 17), None if stub else (i % 120 + 0.1, i % 80 + 0.2),
                None if stub or i % 4 else ((i * 7) % 120, (i * 5) % 80), poss=poss, us=us,
                team=us if i % 5 else 1 - us, ts=i * 1.7, period=1 if i < 50 else 2,
                counterpress=i % 7 == 0,
            )
        )
    return rows


@pytest.mark.parametrize("bits", [1, 3])
def test_small_blocks_change_nothing(spark, features, monkeypatch, bits):
    """A match cut into many blocks gives the rows of a match that fits into one."""
    rows = long_match()
    whole = features(rows)[1]
    seg = {r["index"]: (r["start_index"], r["idx"], r["chain_start_ts"]) for r in segment(frame_of(spark, rows)).collect()}
    monkeypatch.setattr(scan, "BLOCK_BITS", bits)
    cut_seg = {r["index"]: (r["start_index"], r["idx"], r["chain_start_ts"]) for r in segment(frame_of(spark, rows)).collect()}
    assert cut_seg == seg
    cut = features(rows)[1]
    assert len(cut) == len(whole) > 5
    for a, b in zip(whole, cut):
        a, b = a.asDict(), b.asDict()
        assert b.pop("path_xy") == pytest.approx(a.pop("path_xy"))
        assert a == b


@pytest.mark.parametrize("bits", [2, 4, 16])
def test_ordered_scan_against_plain_loops(spark, monkeypatch, bits):
    monkeypatch.setattr(scan, "BLOCK_BITS", bits)
    rows = [(k, i * 2 + k, (i * 5) % 7 if i % 3 else None) for k in (0, 1) for i in range(23)]
    df = spark.createDataFrame(rows, "k int, o long, v int")
    got = scan.ordered_scan(
        df, ["k"], "o", lag={"p": F.col("v"), "po": F.col("o")}, lead={"nx": F.col("o")},
        sums={"s": F.coalesce("v", F.lit(0))}, last={"h": F.col("v")}, maxima={"m": F.col("v")},
        totals={"t": F.lit(1)},
    ).orderBy("k", "o").collect()
    for k in (0, 1):
        mine = [r for r in rows if r[0] == k]
        held = best = None
        total = 0
        for i, (r, g) in enumerate(zip(mine, [g for g in got if g["k"] == k])):
            v = r[2]
            total += v or 0
            held = held if v is None else v
            best = v if best is None else best if v is None else max(best, v)
            assert (g["p"], g["po"]) == ((mine[i - 1][2], mine[i - 1][1]) if i else (None, None))
            assert g["nx"] == (mine[i + 1][1] if i + 1 < len(mine) else None)
            assert (g["s"], g["h"], g["m"], g["t"]) == (total, held, best, 23)


def test_numbering_and_previous_chain(features):
    rows = [event(i, 30, (30, 40), (50, 40), poss=i, us=i % 2 + 1, period=1 if i < 4 else 2) for i in range(1, 7)]
    got = features(rows)[1]
    assert [r["seq"] for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r["prev_team_id"] for r in got] == [None, 2, 1, 2, 1, 2]
    assert [r["start_type"] for r in got] == ["regular"] + ["turnover_open_play"] * 2 + ["regular"] + ["turnover_open_play"] * 2


def test_small_blocks_equal_large_ones(spark, tmp_path, monkeypatch):
    """The whole build, once with one block per key and once with several per match and chain."""
    from phasegrid.plans import build as B
    from phasegrid.sources import testdata as TD

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ordered = TD.range_blocks(spark, source, str(tmp_path / "ordered"))
    events = TD.flat_events(spark, ordered).cache()
    frames, matches = TD.flat_frames(events).cache(), TD.match_dimension(events).cache()
    plain = B.build(events, frames, matches, str(tmp_path / "plain"))
    monkeypatch.setattr(scan, "BLOCK_BITS", 2)
    blocks = B.build(events, frames, matches, str(tmp_path / "blocks"))
    for name in ("phase_events", "phase_frames"):
        a, b = getattr(plain, name), getattr(blocks, name)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    a, b = plain.phases.drop("path_xy"), blocks.phases.drop("path_xy")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    other = blocks.phases.select("phase_id", F.col("path_xy").alias("o"))
    gap = F.array_max(F.zip_with("path_xy", "o", lambda x, y: F.abs(x - y)))
    assert plain.phases.join(other, "phase_id").agg(F.max(gap)).first()[0] < 1e-4


def test_sides_that_grow_are_not_broadcast(spark):
    """Small tables would be broadcast; Spark takes large ones, compressed, for small."""
    rows = [event(i, 30, (10 + i, 40), (12 + i, 40), related_events=[f"u1-{i + 1}"]) for i in range(1, 5)]
    events = frame_of(spark, rows)
    seg = segment(events)
    seg = spark.createDataFrame(seg.collect(), seg.schema)
    chains = X.aggregate_chains(seg)
    joined = [
        build.mark_frames(events.drop("has_frame"), events.select("match_id", "event_uuid")),
        X.presses_before(chains, seg, 5.0),
        profiling.related_pairs(events),
        scan.join_fragments(seg.withColumn("_b", F.lit(0)), chains.select(*CHAIN, "n_events"), CHAIN, "_b"),
        scan.join_fragments(seg.withColumn("_b", F.lit(0)), chains.select(*CHAIN, "n_events"), CHAIN, "_b", "n_events"),
    ]
    for df in joined:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [df.count() for df in joined] == [4, 1, 3, 4, 4]
