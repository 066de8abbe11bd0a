import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import common as C
from phasegrid.llm import parity_join as J
from phasegrid.llm.graph import components

from .conftest import prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(seed, n, words=60):
    """Copies of one text, each with its own few changed words: similarities around 3/4."""
    rng = random.Random(seed)
    base = prose(rng, words).split(" ")
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(words)] = f"new{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("split,members", [(J.SPLIT, J.CHUNK_MEMBERS), (2, 4)])
def test_components_equal_brute_force(spark, corpus, split, members):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    rows += [(1000 + i, t) for s in range(3) for i, t in enumerate(family(s, 25), 100 * s)]
    rows += [(2000 + i, " ".join(f"t{j}" for j in range(k))) for i, k in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 10))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_components(df, split=split, members=members).collect()}
    assert got == brute(rows)


def test_hard_rows(spark, empty):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d\te F"), (3, None), (4, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in J.link_components(df).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
    assert J.link_components(empty).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for size in (40, 300, 3000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 9 :], rng.integers(0, 2**64, size // 12, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        sa, sb = (np.frombuffer(J.sketch(x, len(x)), np.uint8) for x in (a, b))
        width = min(len(sa), len(sb))
        fold = lambda s: np.bitwise_xor.reduce(s.reshape(-1, width), axis=0)
        assert np.bitwise_count(fold(sa) ^ fold(sb)).sum() <= apart
        assert min(len(a), len(b)) / max(len(a), len(b)) > 0.75
        keys = []
        for s in (a, b):
            band = J.bands_of(np.array([len(a)]))
            keys.append(set(J.blocks(np.sort(s), np.array([0, len(s)]), band)[0].tolist()))
        assert max(len(keys[0] - keys[1]), len(keys[1] - keys[0])) <= apart


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_spans_break_at_rows():
    raw = [b"ab c", b"d", b"", b" e ", b"f"]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    starts, ends, words = C.word_spans(np.frombuffer(b"".join(raw), np.uint8), off)
    joined = b"".join(raw)
    assert [joined[a:b] for a, b in zip(starts, ends)] == [b"ab", b"c", b"d", b"e", b"f"]
    assert words.tolist() == [0, 2, 3, 3, 4, 5]


def test_unlinked_members_of_a_large_group_stay_apart_in_tasks(spark):
    members = 256
    # Members are linked where sizes differ by one: pairs (3k, 3k + 1) for every 50th k only.
    sizes = [3 * k for k in range(1, 3001)] + [3 * k + 1 for k in range(1, 3001, 50)]
    df = spark.createDataFrame([(7, n, n, b"x" * 8) for n in sizes], "gid long, cls long, n long, payload binary")

    def make(n, payload):
        assert len(n) <= 3 * members, f"{len(n)} members in one task"
        return lambda i, others: abs(n[others] - n[i]) == 1

    edges = J.resolve(df.select("gid", "cls"), df.select("cls", "n", F.col("payload").alias("p")), "p", make, members)
    found = {r["node"]: r["label"] for r in components(edges).collect()}
    assert found == {n: 3 * k for k in range(1, 3001, 50) for n in (3 * k, 3 * k + 1)}
