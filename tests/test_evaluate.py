"""Event features, slices, ranks, neighbours, AUC, quantiles, augmentation."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid import constants as K
from phasegrid.functions import scan
from phasegrid.operators import augment as A, evaluate as E, quantile as Q, similar as SIM

COLS = (
    "match_id long, phase_id string, idx long, t_offset_s float, type_id int, team_side string, player_name string,"
    " x float, y float, end_x float, end_y float, under_pressure boolean, counterpress boolean, out boolean, xg float"
)


def row(phase, idx, t, type_id, at=None, to=None, who=None, side="in_possession", up=False, xg=None):
    x, y = at or (None, None)
    ex, ey = to or (None, None)
    return (999, phase, idx, float(t), type_id, side, who, *[None if v is None else float(v) for v in (x, y, ex, ey)], up, False, False, xg)


@pytest.fixture(scope="module")
def store(spark):
    """A six-event move with a switch and a shot, a two-event stub, and a ten-event move."""
    rows = [
        row("999-0001", 0, 0.0, 30, (6, 40), (46, 10), "A"), row("999-0001", 1, 2.0, 42, (46, 10), None, "B"),
        row("999-0001", 2, 2.5, 43, (46, 10), (56, 10), "B"), row("999-0001", 3, 4.0, 17, (60, 70), None, "Z", "opponent"),
        row("999-0001", 4, 4.5, 30, (56, 10), (76, 60), "B", up=True), row("999-0001", 5, 8.0, 16, (105, 40), (120, 40), "C", xg=0.25),
        row("999-0002", 0, 0.0, 30, (60, 40), (70, 40), "A"), row("999-0002", 1, 1.0, 38, (70, 40), None, "D"),
    ]
    rows += [row("999-0003", i, i * 1.5, 43, (10 + 8 * i, 40), (14 + 8 * i, 44), "E") for i in range(10)]
    return spark.createDataFrame(rows, COLS).cache()


def test_event_features(store, spark):
    got = {(r["phase_id"], r["idx"]): r for r in E.event_features(store).collect()}
    a = got["999-0001", 0]
    assert (a["x"], a["y"], a["t_rel"], a["dt"], a["has_end"]) == pytest.approx((-0.9, 0.0, 0.0, 0.0, 1.0))
    assert (a["dx"], a["dy"]) == pytest.approx((40 / 30, -30 / 20))
    b = got["999-0001", 1]
    assert (b["has_end"], b["end_x"], b["dx"]) == (0.0, 0.0, 0.0)
    assert b["t_rel"] == pytest.approx(2 / 30) and b["dt"] == pytest.approx(math.log1p(2.0) / 2)
    assert got["999-0001", 4]["under_pressure"] == 1.0 and got["999-0001", 5]["xg"] == pytest.approx(0.25)
    assert got["999-0001", 3]["side"] == 0.0
    # A tail starts its own clock.
    tail = {r["idx"]: r for r in E.event_features(store.filter("phase_id = '999-0001' AND idx >= 2")).collect()}
    assert tail[2]["t_rel"] == 0.0 and tail[2]["dt"] == 0.0 and tail[3]["x"] == got["999-0001", 3]["x"]
    ids = spark.createDataFrame([(t,) for t in (2, 43, 35, 77)], "t int").select("t", E.type_index(F.col("t")).alias("i"))
    assert {r["t"]: r["i"] for r in ids.collect()} == {2: 1, 43: 32, 35: 33, 77: 0}


def test_padding(store):
    sizes = store.groupBy("phase_id").agg(F.count("*").alias("n_events"))
    got = {r["phase_id"]: r for r in E.padded_windows(E.event_features(store), sizes, 8).collect()}
    assert {k: r["length"] for k, r in got.items()} == {"999-0001": 6, "999-0002": 2, "999-0003": 8}
    stub = got["999-0002"]
    assert stub["mask"] == [True] * 2 + [False] * 6 and stub["types"][2:] == [0] * 6
    assert all(v == [0.0] * 15 for v in stub["numeric"][2:]) and len(got["999-0003"]["numeric"]) == 8


def test_slice_features(store):
    got = {r["phase_id"]: r for r in E.slice_features(store, ["phase_id"]).collect()}
    f = got["999-0001"]
    assert (f["start_x"], f["start_y"], f["end_x"], f["end_y"], f["max_x"]) == (6, 40, 120, 40, 120)
    assert (f["n_passes"], f["n_events"], f["n_players"], f["pressure_events"]) == (2, 6, 3, 1)
    assert f["xg"] == pytest.approx(0.25) and f["duration_s"] == pytest.approx(8.0)
    assert f["progression_m"] == pytest.approx(114 * 0.9144)
    assert f["switch_of_play"] and f["reached_final_third"] and f["reached_box"] and len(f["path_xy"]) == 40
    assert (f["start_zone"], f["end_zone"]) == ("def_third_centre", "final_third_centre")
    half = E.slice_features(store.filter("phase_id = '999-0001' AND idx < 3"), ["phase_id"]).first()
    assert (half["end_x"], half["n_passes"], half["switch_of_play"], half["reached_final_third"]) == (56, 1, False, False)
    only_theirs = store.filter("team_side = 'opponent'")
    assert E.slice_features(only_theirs, ["phase_id"]).count() == 0


def test_halves_need_eight_events(store):
    phases = store.groupBy("phase_id").agg(F.count("*").alias("n_events"))
    got = E.split_halves(store, phases).groupBy("phase_id", "half").count().collect()
    assert sorted((r["phase_id"], r["half"], r["count"]) for r in got) == [("999-0003", 1, 5), ("999-0003", 2, 5)]
    assert {r[0] for r in E.training_phases(phases).select("phase_id").collect()} == {"999-0001", "999-0003"}


def vectors(spark, rows, split="s"):
    return spark.createDataFrame([(i, split, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, split string, vec array<double>")


@pytest.mark.parametrize("block", [2048, 1])
def test_ranks(spark, block):
    def ranks(q, c):
        return {r["id"]: r["rank"] for r in E.rank_of_gold(vectors(spark, q), vectors(spark, c), block).collect()}

    assert ranks([[1, 0], [0, 1]], [[1, 0], [0, 1]]) == {0: 1.0, 1: 1.0}
    assert ranks([[1, 0], [0, 1]], [[0, 1], [1, 0]]) == {0: 2.0, 1: 2.0}
    # A collapsed space scores chance: one plus half of the three ties.
    assert ranks([[1, 0], [1, 0]], [[1, 0]] * 4) == {0: 2.5, 1: 2.5}


def test_ranks_and_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(60, 5)), 1)
    w = np.round(rng.normal(size=(60, 5)), 1)
    got = {r["id"]: r["rank"] for r in E.rank_of_gold(vectors(spark, v), vectors(spark, w), 16).collect()}
    sims = np.round(v @ w.T, 6)
    for i in range(60):
        want = 1 + (sims[i] > sims[i, i]).sum() + ((sims[i] == sims[i, i]).sum() - 1) / 2
        assert got[i] == want
    near = E.nearest_neighbours(vectors(spark, v), 4, 16).collect()
    mine = np.round(v @ v.T, 6)
    np.fill_diagonal(mine, -np.inf)
    for i in range(60):
        want = sorted(range(60), key=lambda j: (-mine[i, j], j))[:4]
        assert [r["neighbour"] for r in sorted(near, key=lambda r: r["place"]) if r["id"] == i] == want


@pytest.mark.parametrize("groups", [2, 24])
def test_candidates_move_once_for_each_group(spark, monkeypatch, groups):
    """Six query blocks in two groups: a candidate block is moved twice, not once for each pair."""
    rng = np.random.default_rng(8)
    rows = [(b + 1, [100 * b + i for i in range(20)], rng.normal(size=(20, 3)).astype("<f4")) for b in range(6)]
    packed = spark.createDataFrame(
        [("all", b, ids, m.tobytes(), [0.0] * 3, 9.0, 9.0, 20) for b, ids, m in rows],
        "split string, block int, id array<long>, matrix binary, centre array<double>, radius double, norm double, rows long",
    )
    pairs = packed.select("split", "block").join(packed.select("split", F.col("block").alias("other")), "split")
    monkeypatch.setattr(E, "GROUPS", groups)
    dealt = E._side_by_side(pairs, packed, packed)
    assert dealt.filter("wanted is null").count() == 6
    assert dealt.filter("wanted is not null").count() == 6 * min(groups, 6)
    schema = "split string, block int, id long, neighbour long, score double"
    found = {}
    for r in dealt.mapInPandas(E._best("<f4", 4), schema).collect():
        found.setdefault(r["id"], []).append((-r["score"], r["neighbour"]))
    ids = np.concatenate([i for _, i, _ in rows])
    m = np.concatenate([m for _, _, m in rows]).astype(float)
    sims = np.round(m @ m.T, 6)
    np.fill_diagonal(sims, -np.inf)
    for i, q in enumerate(ids.tolist()):
        assert [n for _, n in sorted(found[q])[:4]] == [ids[j] for j in np.lexsort((ids, -sims[i]))[:4]]


def test_pivots_come_from_a_share_of_the_rows(spark, monkeypatch):
    """Tasks send the driver few rows more than the sample, which is the one over all rows."""
    rows = spark.range(20_000, numPartitions=20).select("id", F.array(F.sin("id"), F.cos("id")).alias("vec"))
    sorted_rows, sample = [], E._sample

    def counted(vectors, n):
        sorted_rows.append(vectors.count())
        return sample(vectors, n)

    monkeypatch.setattr(E, "_sample", counted)
    pivots = E._pivots(rows, 1000)
    assert 320 <= sorted_rows[0] <= 960 and len(sorted_rows) == 1
    monkeypatch.setattr(E, "_low_hashes", lambda vectors, share: vectors)
    assert (E._pivots(rows, 1000) == pivots).all()


def test_pivots_where_ids_repeat(spark):
    rows = spark.range(3000).select(F.lit(7).alias("id"), F.array(F.sin("id"), F.cos("id")).alias("vec"))
    assert len(E._pivots(rows, 1000)) == 6


def test_bounds_skip_block_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 12)) * 4
    v = np.concatenate([np.round(c + rng.normal(size=(40, 12)) * 0.05, 3) for c in centres])
    rng.shuffle(v)
    df = vectors(spark, v).repartition(5)
    sims = np.round(v @ v.T, 6)
    np.fill_diagonal(sims, -np.inf)
    near = E.nearest_neighbours(df, 3, 40).collect()
    got = {(r["id"], r["place"]): r["neighbour"] for r in near}
    for i in range(0, len(v), 17):
        assert [got[i, p] for p in (1, 2, 3)] == sorted(range(len(v)), key=lambda j: (-sims[i, j], j))[:3]
    report = E.pair_report(df, 3, 40).first()
    assert report["blocks"] >= 20 and report["visited"] < 0.5 * report["blocks"] ** 2
    w = v + rng.normal(size=v.shape) * 0.01
    ranks = {r["id"]: r["rank"] for r in E.rank_of_gold(vectors(spark, w), vectors(spark, v), 40).collect()}
    sims = np.round(w @ v.T, 6)
    for i in range(0, len(v), 13):
        assert ranks[i] == 1 + (sims[i] > sims[i, i] + 5e-7).sum() + ((np.abs(sims[i] - sims[i, i]) <= 5e-7).sum() - 1) / 2


def test_metrics_and_decision(spark):
    m = E.retrieval_metrics(spark.createDataFrame([(i, r) for i, r in enumerate((1.0, 2.0, 10.0, 100.0))], "id int, rank double")).first()
    assert m["n"] == 4 and m["mrr"] == pytest.approx((1 + 0.5 + 0.1 + 0.01) / 4)
    assert (m["recall_1"], m["recall_10"], m["median_rank"]) == (0.25, 0.75, 6.0)
    table = lambda *r: spark.createDataFrame([r], "mrr double, recall_1 double, macro_auc double")
    d = E.ship_decision(table(0.1, 0.02, 0.75), table(0.12, 0.02, 0.741)).first()
    assert d["ship"] and d["mrr_ratio"] == pytest.approx(1.2)
    assert not E.ship_decision(table(0.1, 0.02, 0.75), table(0.12, 0.019, 0.75)).first()["ship"]
    assert not E.ship_decision(table(0.1, 0.02, 0.75), table(0.12, 0.02, 0.73)).first()["ship"]


def test_auc_known_values(spark):
    cases = {
        "best": ([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0), "worst": ([0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1], 0.0),
        "ties": ([0.5] * 4, [0, 0, 1, 1], 0.5), "one swap": ([0.1, 0.5, 0.4, 0.9], [0, 0, 1, 1], 0.75), "one class": ([0.1, 0.2], [1, 1], None),
    }
    rows = [(k, s, bool(y)) for k, (ss, ys, _) in cases.items() for s, y in zip(ss, ys)]
    got = Q.auc(spark.createDataFrame(rows, "k string, s double, y boolean"), "s", "y", ["k"])
    assert {r["k"]: r["auc"] for r in got.collect()} == {k: c[2] for k, c in cases.items()}
    assert E.macro_auc(got.withColumnRenamed("k", "label")).first()["macro_auc"] == pytest.approx((1 + 0 + 0.5 + 0.75) / 4)


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"a": np.round(rng.normal(0, 40, 301), 1), "b": np.round(rng.exponential(0.3, 50), 3), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    points = {"p05": 0.05, "p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}
    got = {r["k"]: r for r in Q.quantiles(df, "v", points, ["k"]).collect()}
    near = {r["k"]: r for r in Q.quantiles(df, "v", points, ["k"], nearest=True).collect()}
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        for name, p in points.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), abs=1e-9)
            assert near[k][name] == sorted(vs)[round(p * (len(vs) - 1))]
    assert Q.quantiles(df, "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_vectors(spark):
    stats = {c: (0.0, 1.0) for c in K.NUMERIC_FEATURES}
    base = {c: 1.0 for c in K.NUMERIC_FEATURES} | {c: True for c in K.BOOL_FEATURES}
    base |= {"duration_s": 50.0, "start_type": "corner", "outcome": None, "start_zone": "def_third_left", "end_zone": "final_third_right", "path_xy": [60.0, 40.0] * 20}
    df = spark.createDataFrame([base], ", ".join(
        f"{c} {'double' if c in K.NUMERIC_FEATURES else 'boolean' if c in K.BOOL_FEATURES else 'array<double>' if c == 'path_xy' else 'string'}" for c in base))
    v = np.array(SIM.phase_vectors(df, stats).first()["vec"])
    raw = np.concatenate([[3.0], np.ones(12), np.full(5, 0.8), np.eye(7)[2] * 0.7, np.zeros(7), np.eye(9)[0] * 0.6, np.eye(9)[8] * 0.6, np.zeros(24)])
    assert len(v) == 74 and v == pytest.approx(raw / np.linalg.norm(raw), abs=1e-6)


# Augmentation invariants ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def moves(spark):
    rows = [row(f"9-{p:04d}", i, i * 0.7 + (i % 3) * 0.1, 30, (i % 100 + 1, 40), None if i % 2 else (i % 90 + 2, 30), "A")
            for p in range(40) for i in range(1 + p % 23)]
    return spark.createDataFrame(rows, COLS).select("phase_id", "idx", "t_offset_s", "x", "y", "end_x", "end_y").cache()


def by_phase(df):
    out = {}
    for r in df.orderBy("phase_id", "idx").collect():
        out.setdefault(r["phase_id"], []).append(r)
    return out


@pytest.mark.parametrize("bits", [16, 2])
def test_augmentations(moves, monkeypatch, bits):
    monkeypatch.setattr(scan, "BLOCK_BITS", bits)
    whole = by_phase(moves)
    crops = by_phase(A.crop(moves, 11))
    drops = by_phase(A.drop_events(moves, 11, 0.9))
    jit = by_phase(A.jitter_locations(moves, 11))
    tempo = by_phase(A.stretch_tempo(moves, 11))
    moved = []
    for p, all_rows in whole.items():
        n = len(all_rows)
        idx = [r["idx"] for r in crops[p]]
        assert idx == list(range(idx[0], idx[0] + len(idx)))
        assert len(idx) == n if n < 4 else max(3, math.floor(0.6 * n)) <= len(idx) <= n
        kept = [r["idx"] for r in drops[p]]
        assert kept[0] == 0 and kept[-1] == n - 1 and len(kept) >= min(n, 3)
        assert n >= 5 or len(kept) == n
        for a, b in zip(all_rows, jit[p]):
            assert (a["end_x"] is None) == (b["end_x"] is None) and a["t_offset_s"] == b["t_offset_s"]
            moved.append(b["x"] - a["x"])
        t0, t1 = [r["t_offset_s"] for r in all_rows], [r["t_offset_s"] for r in tempo[p]]
        assert t1[0] == pytest.approx(t0[0])
        ratios = [(b - t1[0]) / (a - t0[0]) for a, b in zip(t0[1:], t1[1:])]
        assert not ratios or (max(ratios) - min(ratios) < 1e-5 and 0.5 < ratios[0] < 2)
    assert abs(np.mean(moved)) < 0.15 and 0.6 < np.std(moved) < 1.0
    again, other = by_phase(A.augment(moves, 11)), by_phase(A.augment(moves, 12))
    assert again == by_phase(A.augment(moves, 11)) and again != other
    assert A.drop_events(moves, 1, 0.0) is moves


def hard_vectors(kind):
    """Clusters, equal rows, a row without direction, one not a number, and lengths far apart."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(3, 6))[rng.integers(0, 3, 90)] + rng.normal(size=(90, 6)) * 1e-4
    m[20:50] = m[20]
    m[50] = 0
    m[51, 2] = np.nan
    m[60:70] *= 1e4
    if kind == "<f8":
        m[70:74] *= 1e25  # products beyond single precision
    return m.astype(kind)


@pytest.mark.parametrize("kind", ["<f4", "<f8"])
def test_best_others_and_counts_equal_all_products(monkeypatch, kind):
    """Single precision with a margin, pieces and merges give what all products in double precision give."""
    monkeypatch.setattr(E, "SLICE_ROWS", 16)
    monkeypatch.setattr(E, "PIECE_ROWS", 8)
    monkeypatch.setattr(E, "EXACT_ROWS", 5)
    m = hard_vectors(kind)
    ids = np.array([f"p{i % 85:03d}" for i in range(90)])  # some ids twice
    with np.errstate(invalid="ignore"):
        sims = np.round(m.astype(float) @ m.astype(float).T, 6)
    rng = np.random.default_rng(12)
    for share in (0, 4):  # few exact products, and all of a piece
        monkeypatch.setattr(E, "EXACT_SHARE", share)
        best = E._Best(("all", 1), E._Vectors(ids, m.tobytes(), kind), 5)
        parts = np.array_split(rng.permutation(90), 4)
        for part in parts:
            best.meet(E._Vectors(ids[part], m[part].tobytes(), kind).by_id())
        held = {}
        for start in list(best.held):
            best._merge(start)
            at, score, others = best.held[start][0]
            for a, s, o in zip(at, score, others):
                held.setdefault(int(start + a), []).append((-s, o))
        for i in range(90):
            want = sorted((-sims[i, j], ids[j]) for j in range(90) if ids[j] != ids[i] and np.isfinite(sims[i, j]))[:5]
            got = sorted(held.get(i, []))
            assert np.allclose([s for s, _ in got], [s for s, _ in want], rtol=1e-12, atol=0), i
            # Sums of numbers so large end in another digit in another order.
            assert [o for s, o in got if abs(s) < 1e10] == [o for s, o in want if abs(s) < 1e10], i
        level = sims[np.arange(90), (np.arange(90) * 7 + 1) % 90]
        level = np.where((np.arange(90) % 2 == 1) & ~(np.abs(level) > 1e10), level, 0.5)
        greater, equal = np.zeros(90, int), np.zeros(90, int)
        mine = E._Vectors(ids, m.tobytes(), kind)
        for part in parts:
            E._count_above(mine, level, greater, equal, E._Vectors(ids[part], m[part].tobytes(), kind))
        assert (greater == (sims > level[:, None] + 5e-7).sum(axis=1)).all()
        assert (equal == (np.abs(sims - level[:, None]) <= 5e-7).sum(axis=1)).all()


def test_groups_are_dealt_evenly(spark):
    """Each group of query blocks has a partition of its own; by their hashes several shared one."""
    for parts in (6, 24, 41):
        deal = spark.createDataFrame([(i,) for i in E._dealt(spark, parts)], "i int")
        assert deal.repartition(parts, "i").select(F.spark_partition_id()).distinct().count() == parts


def test_tasks_return_their_best_only(spark):
    """A task gave up to k rows for each candidate block; now k for each query."""
    rng = np.random.default_rng(13)
    rows = [(b, [100 * b + i for i in range(30)], rng.normal(size=(30, 4)).astype("<f4").tobytes()) for b in range(1, 9)]
    packed = spark.createDataFrame(
        [("all", b, ids, m, [0.0] * 4, 9.0, 9.0, 30) for b, ids, m in rows],
        "split string, block int, id array<long>, matrix binary, centre array<double>, radius double, norm double, rows long",
    )
    pairs = packed.select("split", "block").join(packed.select("split", F.col("block").alias("other")), "split")
    schema = "split string, block int, id long, neighbour long, score double"
    assert E._side_by_side(pairs, packed, packed).mapInPandas(E._best("<f4", 3), schema).count() == 8 * 30 * 3
