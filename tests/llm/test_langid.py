import math
import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from phasegrid.llm import langid as L

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab"]


def forward(word, prob):
    """Sum over all segmentations by plain recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        head = word[:k]
        p = prob.get(head, prob["?"] if k == 1 else 0.0)
        if p:
            total += p * forward(word[k:], prob)
    return total


def codes(word):
    return np.array([[ord(c) for c in word]], np.uint64)


def test_forward_sums_all_segmentations():
    lattice = L.Lattice(PIECES)
    rng = np.random.default_rng(0)
    p = rng.random((len(PIECES) + 2, 2))
    p[-2] = 0
    for word in ("▁ab", "▁abab", "▁bbaab", "▁axb", "x"):
        alpha, _ = lattice.forward(codes(word), p)
        for lang in range(2):
            table = {q: p[i, lang] for i, q in enumerate(PIECES)} | {"?": p[-1, lang]}
            assert math.isclose(alpha[-1][0, lang] / L.GAIN ** len(word), forward(word, table), rel_tol=1e-9)


def test_expected_uses_are_derivatives():
    lattice = L.Lattice(PIECES)
    p = np.full((len(PIECES) + 2, 1), 0.1)
    p[-2] = 0
    word = codes("▁abab")
    uses = lattice.expected(word, p, np.ones((1, 1)))
    for i in range(len(PIECES)):
        up = p.copy()
        up[i] *= 1 + 1e-6
        gain = np.log(lattice.forward(word, up)[0][-1]) - np.log(lattice.forward(word, p)[0][-1])
        assert math.isclose(uses[i, 0], float(gain[0, 0]) / 1e-6, rel_tol=1e-3, abs_tol=1e-6)


def test_held_out_accuracy_and_contract(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = L.identify(df, P.path("piece_bpe_32k.model"))
    rows = out.join(df.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.95


def test_hard_rows(spark, corpus, empty):
    path = P.path("piece_bpe_32k.model")
    out = L.identify(corpus.withColumn("held_out", F.lit("clash")), path)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = {r["doc_id"]: r for r in out.collect()}
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert len(by) == len(texts)
    for i, t in texts.items():
        assert (by[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
    assert L.identify(empty, path).count() == 0
    nothing = L.identify(corpus.withColumn("lang", F.lit(None).cast("string")), path)
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    rng = random.Random(0)
    odd = spark.createDataFrame([(1, "漢字 " * 50), (2, "12 34 !"), (3, "".join(rng.choice("abc") for _ in range(5000)))], "doc_id long, text string")
    model = (["x", "y"], np.vstack([np.full((len(PIECES), 2), 0.1), np.zeros((1, 2)), np.full((1, 2), 1e-6)]))
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(odd, model, PIECES).collect()}
    assert got == {1: "x", 2: "und", 3: "x"}


def test_long_uncovered_runs_do_not_spoil_the_model(spark):
    texts = [(i, ("the ship of the sea " if i % 2 else "das schiff auf dem meer ") * 5, "en" if i % 2 else "de") for i in range(60)]
    odd = [(100 + i, "漢" * 60 + "\U0001F600" * 200, "de") for i in range(4)] + [(None, "x" * 500, "en")] * 3
    df = spark.createDataFrame(texts + odd, "doc_id long, text string, lang string")
    rows = L.identify(df, P.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(texts) + len(odd)
    assert all(0 <= r["score"] <= 1 for r in rows)
    truth = {i: g for i, _, g in texts}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["doc_id"] in truth)
    model = L.learn(df, L.read_pieces(P.path("piece_bpe_32k.model")))
    assert np.isfinite(model[1]).all()


def test_repeated_ids_do_not_pass_the_bound(spark):
    df = spark.createDataFrame([(None, f"word{i} more", "en") for i in range(50)], "doc_id long, text string, lang string")
    langs, prob = L.learn(df, PIECES, rows=10)
    assert langs == ["en"] and np.isclose(prob[:-2].sum(), 1)
