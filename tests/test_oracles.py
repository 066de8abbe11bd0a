"""Registered queries: shape of the registry, and twins on the smallest folder."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from phasegrid import catalog
from tools_check import normal

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "segmented_events", "chain_diagnostics", "phase_table", "phase_paths", "phase_events", "phase_frame_dots",
    "search_between", "search_many", "request_orders", "saved_canonical", "counter_stats", "half_ranks_strict",
    "augmented_events", "current_frames", "quality_checks",
)


def test_every_query_has_a_twin():
    own = set(catalog.queries())
    assert own <= set(entry.queries()) and own <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 48
