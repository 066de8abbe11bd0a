import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phasegrid.llm import decontaminate as D

from .conftest import prose


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def similarity(a, b):
    weigh = lambda c: sum(n * sum(map(len, s)) for s, n in c.items())
    common = weigh(a & b)
    return common / (weigh(a) + weigh(b) - common)


def brute(docs, items):
    """Best similarity of every item-sized window, over all starts."""
    out = {}
    classes = {}
    for i, t in items:
        w = tuple(words(t))
        if len(w) >= 5:
            classes[w] = min(i, classes.get(w, i))
    for d, t in docs:
        w = words(t)
        for item, i in classes.items():
            best = max((similarity(bag(w[s : s + len(item)]), bag(list(item))) for s in range(max(1, len(w) - len(item) + 1))), default=0) if len(w) >= 5 else 0
            if best >= 0.75:
                out[d, i] = best
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randint(14, 50))) for i in range(25)] + [(90, "too few words"), (91, None)]
    items.append((50, items[3][1]))
    docs = [(i, prose(rng, 80)) for i in range(40)]
    for k in range(60):
        w = items[k % 25][1].split(" ")
        for _ in range(k // 25):
            w[rng.randrange(len(w))] = "swap"
        docs.append((100 + k, f"{prose(rng, 20)}\n{' '.join(w).upper() if k % 5 == 0 else ' '.join(w)}\n{prose(rng, 20)}"))
    for k in range(120):  # words inserted or left out: before, between and behind the anchors
        w = items[k % 25][1].split(" ")
        for _ in range(1 + k // 50):
            at = rng.choice([0, 1, 2, len(w) // 2, rng.randrange(len(w)), len(w) - 1])
            w[at:at + k % 2] = [] if k % 2 else ["put"] * rng.randint(1, 2)
        docs.append((200 + k, f"{prose(rng, 20)} {' '.join(w)} {prose(rng, 20)}"))
    docs += [(500, items[0][1]), (501, " ".join([items[1][1]] * 3)), (502, None), (503, "")]
    return docs, items


def test_all_windows_are_found(spark, made):
    docs, items = made
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit("clash"), "h": F.lit(1)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("size", F.lit("x"))
    got = {(r["doc_id"], r["item"]): r["similarity"] for r in D.contaminated(d, b).collect()}
    want = brute(docs, items)
    assert len(want) > 100
    missed = {k: v for k, v in want.items() if k not in got}
    assert len(missed) <= 0.01 * len(want)
    assert set(got) <= set(want)
    assert all(got[k] <= want[k] + 1e-9 for k in got)
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) >= 0.99 * len(got)
    clean = D.clean(d, b)
    assert clean.columns == d.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_fingerprints_within_the_radius_meet_and_few_others_do(spark):
    rng = random.Random(0)
    for _ in range(500):
        bits = rng.sample(range(128), D.RADIUS)
        assert min(sum(b // D.BLOCK_BITS == j for b in bits) for j in range(D.BLOCKS)) <= D.FLIPS
    marks = [[rng.randrange(1 << 16) for _ in range(8)] for _ in range(30)]
    near = [list(m) for m in marks]
    for m in near:
        for b in rng.sample(range(128), D.RADIUS):
            m[b // 16] ^= 1 << (b % 16)
    far = [[rng.randrange(1 << 16) for _ in range(8)] for _ in range(300)]
    contents = spark.createDataFrame([(i, 9, b) for i, b in enumerate(near + far)], "content long, size int, blocks array<int>")
    items = spark.createDataFrame([(i, 9, b) for i, b in enumerate(marks)], "item long, size int, item_blocks array<int>")
    pairs = {tuple(r) for r in D.candidate_pairs(contents, items).collect()}
    assert {(i, i) for i in range(30)} <= pairs
    assert sum(c >= 30 for c, _ in pairs) < 0.15 * 300 * 30  # 0.085 expected


def test_hard_rows(spark, made, corpus, empty):
    _, items = made
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, items[2][1]), (1, items[2][1]), (1, items[2][1]), (2, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item"], r["n_words"]) for r in D.contaminated(d, b).collect()) == [
        (0, 2, len(items[2][1].split())), (1, 2, len(items[2][1].split()))]
    assert [r["doc_id"] for r in D.clean(d, b).collect()] == [2]
    assert D.clean(corpus, b).count() == corpus.count()
    assert D.contaminated(empty, b).count() == D.contaminated(corpus, b.limit(0)).count() == 0
