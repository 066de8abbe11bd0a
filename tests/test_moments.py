"""Moments of matches: merged and refreshed ones equal those computed over all phases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import similar
from phasegrid.plans import build as B
from phasegrid.sources import snapshots, storage


@pytest.fixture(scope="module")
def phases(spark):
    return B.testdata_tables(spark, "/root/testdata/sf0.001").phases


def same(got, want):
    assert got.keys() == want.keys()
    for c, pair in want.items():
        assert got[c] == pytest.approx(pair, rel=1e-9, abs=1e-9), c


def test_merged_moments_equal_those_of_all_phases(phases):
    same(similar.merge_moments(similar.match_moments(phases)), similar.fit_moments(phases))


def test_far_means_do_not_cancel(phases):
    """A small spread around a large mean keeps its digits, also with nulls and one constant column."""
    far = phases.withColumns({
        "xg": F.lit(1e8) + F.col("seq") % 3, "duration_s": F.lit(4.5),
        "start_x": F.when(F.col("seq") % 2 == 0, F.col("start_x")), "end_y": F.lit(None).cast("double"),
    })
    same(similar.merge_moments(similar.match_moments(far)), similar.fit_moments(far))


def test_refreshed_moments_equal_a_fit_after_the_replacement(spark, phases):
    path = storage.new_path(spark, "moments")
    snapshots.write(similar.match_moments(phases), path)
    ids = [r[0] for r in phases.select("match_id").distinct().orderBy("match_id").collect()]
    changed = phases.filter(F.col("match_id") == ids[0]).withColumn("xg", F.col("xg") + 1)
    added = phases.filter(F.col("match_id") == ids[-1]).withColumn("match_id", F.lit(77).cast("long"))
    gone = phases.filter(F.col("match_id").isin(ids[:2])).select("match_id").distinct()
    got = similar.refresh_moments(spark, path, changed.unionByName(added), gone)
    now = phases.filter(~F.col("match_id").isin(ids[:2])).unionByName(changed).unionByName(added)
    same(got, similar.fit_moments(now))


def test_no_phases(spark, phases):
    assert set(similar.merge_moments(similar.match_moments(phases.limit(0))).values()) == {(0.0, 1.0)}
