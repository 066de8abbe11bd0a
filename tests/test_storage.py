"""Stored manifest, replacement of matches, literals beyond a column's type, empty builds."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import quantile, search as S
from phasegrid.plans import build as B, quality as Q, reports as RP
from phasegrid.sources import snapshots as N, storage


@pytest.fixture(scope="module")
def built(spark):
    return B.testdata_tables(spark, "/root/testdata/sf0.001")


def bad(t, stored):
    return {r["check_id"] for r in Q.manifest_checks(t, stored).filter("bad_rows > 0").collect()}


def test_a_tampered_manifest_fails(built):
    stored = RP.stored_manifest(built)
    assert not bad(built, stored)
    wrong = stored.withColumn("value", F.col("value") + F.when(F.col("item").isin("phases", "bytes_matches"), 1).otherwise(0))
    assert bad(built, wrong) == {"manifest_phases", "manifest_bytes_matches"}
    assert "manifest_raw_events" in bad(built, stored.filter("item <> 'raw_events'"))
    fewer = dataclasses.replace(built, phase_events=built.phase_events.limit(3))
    assert "manifest_phase_events" in bad(fewer, stored)


ROWS = [(m, i, f"{m}-{i}") for m in range(60) for i in range(3)]


def stored(spark, rows=ROWS):
    path = storage.new_path(spark, "snapshot")
    df = spark.createDataFrame(rows, "match_id long, idx long, v string")
    return path, N.write(df, path, "idx")


def content(df):
    return sorted(tuple(r) for r in df.select("match_id", "idx", "v").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "match_id long, idx long, v string")


def test_only_the_replaced_matches_change(spark):
    path, before = stored(spark)
    assert content(before) == ROWS and N.buckets_in(before) == N.LEAST_BUCKETS
    new = [(7, 0, "new"), (1000, 0, "added"), (8, 5, "not named")]  # 9 goes, 1000 and 8 are in the rows alone
    named = spark.createDataFrame([(7,), (9,)], "match_id long")
    now = N.replace_matches(spark, path, frame(spark, new), named)
    want = sorted([r for r in ROWS if r[0] not in (7, 8, 9)] + new)
    assert content(now) == content(N.read(spark, path)) == want
    assert content(before) == ROWS  # a reader of the old snapshot still sees it whole
    again = N.replace_matches(spark, path, frame(spark, []), spark.createDataFrame([(7,)], "match_id long"))
    assert content(again) == [r for r in want if r[0] != 7]
    assert N.vacuum(spark, path) > 0 and content(N.read(spark, path)) == content(again)


def test_emptied_buckets_stay_empty(spark):
    path, df = stored(spark)
    one = df.filter("bucket = 3").select("match_id").distinct()
    ids = {r[0] for r in one.collect()}
    now = N.replace_matches(spark, path, frame(spark, []), one)
    assert ids and content(now) == [r for r in ROWS if r[0] not in ids]
    everything = N.replace_matches(spark, path, frame(spark, []), df.select("match_id").distinct())
    assert content(everything) == [] and everything.columns == df.columns
    back = N.replace_matches(spark, path, frame(spark, [(5, 0, "x"), (None, 1, "y")]))
    assert {r["v"] for r in back.collect()} == {"x", "y"}


def test_a_failed_write_changes_nothing(spark):
    path, df = stored(spark)
    broken = frame(spark, [(7, 0, "new")]).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        N.replace_matches(spark, path, broken)
    assert content(N.read(spark, path)) == ROWS
    # a writer that dies between staging and publishing leaves folders that nobody reads
    number, manifest = N._current(spark, path)
    N._stage(frame(spark, [(7, 0, "half")]), path, manifest)
    assert content(N.read(spark, path)) == ROWS


def test_the_slower_of_two_writers_is_told(spark, monkeypatch):
    path, _ = stored(spark)
    stage = N._stage

    def overtaken(*args):
        monkeypatch.setattr(N, "_stage", stage)
        N.replace_matches(spark, path, frame(spark, [(1, 0, "first")]))
        return stage(*args)

    monkeypatch.setattr(N, "_stage", overtaken)
    with pytest.raises(N.Conflict):
        N.replace_matches(spark, path, frame(spark, [(2, 0, "second")]))
    assert content(N.read(spark, path)) == sorted([r for r in ROWS if r[0] != 1] + [(1, 0, "first")])


def test_bucket_count_follows_the_rows(spark):
    assert [N.buckets_for(n) for n in (0, 10**6, 10**8, 10**13)] == [8, 8, 95, N.MOST_BUCKETS]
    path = storage.new_path(spark, "snapshot")
    df = N.write(frame(spark, ROWS), path, "idx", size=200 * N.ROWS_PER_BUCKET)
    assert N.buckets_in(df) == 200 and content(df) == ROWS
    plan = df.filter(F.col("bucket") == N.bucket_of(F.lit(7), 200))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


@pytest.mark.parametrize("op,value,kept", [
    ("lte", 3_000_000_000, 2), ("gte", 3_000_000_000, 0), ("gte", -3_000_000_000, 2), ("eq", 2**40, 0), ("neq", 2**40, 2),
    ("in", [1, 2**40], 1), ("in", [2**40], 0), ("between", [2, 2**40], 1), ("between", [2**40, 2**41], 0), ("between", [-(2**70), 2**70], 2),
])
def test_literals_beyond_the_type(spark, op, value, kept):
    df = spark.createDataFrame([(1,), (2,), (None,)], "period int")
    assert df.filter(S.filter_column({"field": "period", "op": op, "value": value}, df.schema)).count() == kept


def test_an_empty_build_has_all_tables(spark, built, tmp_path):
    t = B.build(built.events.limit(0), built.frames.limit(0), built.matches, str(tmp_path / "none"))
    assert [getattr(t, n).count() for n in ("phases", "phase_events", "phase_frames", "similarity")] == [0] * 4


def test_crowded_values_are_ranked_exactly(spark):
    rows = [(1 - i * 1e-9, i % 3 == 0) for i in range(500)] + [(0.5, True)]
    df = spark.createDataFrame(rows, "v double, p boolean")
    got = quantile.quantiles(df, "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()
    values = sorted(v for v, _ in rows)
    assert (got["n"], got["lo"], got["mid"], got["hi"]) == (501, values[0], values[250], values[-1])
    pos = [v for v, p in rows if p]
    neg = [v for v, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert quantile.auc(df, "v", "p").first()["auc"] == pytest.approx(want)
