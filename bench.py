"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

``build`` starts from the flat events (the input the view derives once) and writes every
published table, like the reference's batch build.  The other entries read the built tables.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from phasegrid import catalog
from phasegrid.operators import search as S, similar as SIM
from phasegrid.plans import build as B
from phasegrid.session import local_session
from phasegrid.sources import storage, testdata

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
# Registered queries timed as they are.
NAMES = (
    "search_high_turnover_shot", "search_counter_box", "search_goal_kick_final_third",
    "search_switch_shot", "search_highest_xg", "search_many", "outcome_mix", "start_zone_map",
    "duration_progression_grid", "regain_deciles", "counter_stats", "quality_checks",
    "event_features", "half_features", "request_filters", "ball_keyframes", "current_frames",
    "nearest_embeddings",
)


def timed(fn) -> float:
    t0 = time.perf_counter()
    out = fn()
    if out is not None:
        out.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    spark = local_session(CPUS, "phasegrid-bench")
    base = storage.new_path(spark, "bench")
    source = spark.read.parquet(f"{SF_DIR}/events.parquet")
    ordered = testdata.range_blocks(spark, source, f"{base}/ordered")
    events = storage.save(testdata.flat_events(spark, ordered), f"{base}/events")
    frames = storage.save(testdata.flat_frames(events), f"{base}/frames")
    matches = testdata.match_dimension(events)

    times: dict[str, float] = {}
    built = []
    times["build_cold"] = timed(lambda: built.append(B.build(events, frames, matches, f"{base}/cold")))
    times["build"] = timed(lambda: built.append(B.build(events, frames, matches, f"{base}/warm")))
    tables = built[-1]
    B.remember(spark, SF_DIR, tables)

    four = {
        "filters": [
            {"field": "duration_s", "op": "gte", "value": 2},
            {"field": "reached_box", "op": "eq", "value": True},
            {"field": "start_type", "op": "eq", "value": "turnover_open_play"},
            {"field": "xg", "op": "gte", "value": 0.05},
        ],
        "order_by": {"field": "xg", "dir": "desc"},
        "limit": 48,
    }
    target = tables.phases.agg(F.min("phase_id")).first()[0]
    direct = {
        "count_phases": lambda: tables.phases.agg(F.count("*")),
        "four_filters_top48": lambda: S.search(tables.phases, four),
        "similar_top48": lambda: SIM.similar_phases(tables.similarity, tables.phases, target, 48),
    }
    for name, make in direct.items():
        timed(make)
        times[name] = timed(make)
    registered = catalog.queries()
    for name in NAMES:
        times[name] = timed(lambda: registered[name](spark, SF_DIR))
    n_events = events.count()
    total = round(sum(v for k, v in times.items() if k != "build_cold"), 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of build and headline queries",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "events": n_events,
                "build_events_per_sec": round(n_events / times["build"]),
                "phases": tables.phases.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
