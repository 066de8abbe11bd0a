import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from phasegrid.llm import chat as H


def test_markers(spark):
    lines = ["User: hi", "### Assistant", "<|im_start|>system", "[Human] x", "**Bot:** y", "note: z", "", "usher: no", "ai: ok", "plain text", "Answer", "Me", "model  ", "**tool**", "[agent]", "<|tool|>x"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = [r["m"] for r in df.orderBy("i").select(H.marker_of(F.col("line")).alias("m")).collect()]
    assert got == [1, 2, 0, 1, 2, 4, 4, 4, 2, 4, 4, 4, 4, 3, 2, 3]


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    k, n = len(H.ROLES), 5
    model = {name: np.log(rng.random((k, k))) for name in ("step", "stay")}
    emission, starts = np.log(rng.random((n, k))), np.array([1, 0, 1, 1, 0])
    entry = np.log(rng.random(k))
    score, back = H.viterbi(emission, starts, model, entry)

    def total(first, path):
        s, prior = entry[first], first
        for e, b, r in zip(emission, starts, path):
            s += model["step" if b else "stay"][prior, r] + e[r]
            prior = r
        return s

    best = max(total(f, p) for f in range(k) for p in itertools.product(range(k), repeat=n))
    assert np.isclose(score.max(), best)


def conversations(seed, n, hide):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(2, 9)):
            role = "user" if t % 2 == 0 else "assistant"
            text = "What is this?" if role == "user" else "\n".join(["It is a long explanation of many words. " * 4] * 2)
            rows.append((c, t, None if rng.random() < hide else role, text, role))
    return rows


def test_missing_labels_are_recovered(spark):
    rows = conversations(3, 60, 0.3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, truth string")
    got = {(r["conv_id"], r["turn"]): r["role"] for r in H.parse(df.drop("truth")).collect()}
    hidden = [(c, t, truth) for c, t, role, _, truth in rows if role is None]
    assert len(hidden) > 50
    assert np.mean([got[c, t] == truth for c, t, truth in hidden]) >= 0.95
    assert all(got[c, t] == truth for c, t, role, _, truth in rows if role)


def test_blocks_give_the_same_roles(spark, monkeypatch):
    rows = conversations(5, 6, 0.4) + [(99, t, ["user", None][t % 2], f"line {t % 7}") for t in range(300)]
    df = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")
    key = lambda out: sorted((r["conv_id"], r["turn"], r["row"], r["part"], r["role"]) for r in out.collect())
    whole = key(H.parse(df))
    monkeypatch.setattr(H, "TURNS_PER_BLOCK", 4)
    monkeypatch.setattr(H, "ROWS_PER_BLOCK", 2)
    assert key(H.parse(df)) == whole


def test_inline_markers_split_a_turn(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello\nAssistant: hi there\nmore"), (1, 1, "user", "bye")], "conv_id long, turn long, role string, text string")
    got = [(r["turn"], r["part"], r["role"], r["text"]) for r in H.parse(df).orderBy("turn", "part").collect()]
    assert got == [(0, 0, "user", "hello"), (0, 1, "assistant", "hi there\nmore"), (1, 0, "user", "bye")]
    assert H.parse(df).orderBy("turn", "part").first()["rendered"] == "<|user|>\nhello\n<|end|>"


def test_hard_rows(spark):
    schema = "conv_id long, turn long, role string, text string, block string"
    rows = [(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, None, None), (None, 0, "SYSTEM", "b", "x"), (None, 0, "user", "c", "x"), (2, 3, "??", "", "x")]
    got = H.parse(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5
    assert {(r["conv_id"], r["turn"]) for r in got} == {(1, 0), (1, None), (None, 0), (2, 3)}
    assert {r["role"] for r in got if r["text"] == "b"} == {"system"}
    assert H.parse(spark.createDataFrame([], schema)).count() == 0


def test_no_word_of_a_turn_is_lost(spark):
    body = "Pick one\nAnswer\nModel\nMe\nuser\nthe end"
    df = spark.createDataFrame([(1, 0, "user", body), (1, 1, "assistant", "Answer: yes")], "conv_id long, turn long, role string, text string")
    got = [(r["turn"], r["part"], r["role"], r["text"]) for r in H.parse(df).orderBy("turn", "part").collect()]
    assert got == [(0, 0, "user", body), (1, 0, "assistant", "yes")]
