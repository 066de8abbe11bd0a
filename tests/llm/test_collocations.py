import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import collocations as K

CUT, WORD = re.compile(r"[.,;:!?\x0a-\x0d]"), re.compile(r"[^\x20\x09]+")


def brute(rows, least=10, longest=3, top=2000, percent=50):
    """The contract by plain loops: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in CUT.split(folded):
            words = WORD.findall(piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= percent * f[lang, words[i : i + k]]:
                    covered.add((lang, words[i : i + k]))
    by_lang = {}
    for (lang, words), a in found.items():
        if (lang, words) in covered:
            continue
        score, _, left, right = min(
            (1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
            for k in range(1, len(words))
        )
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, items in by_lang.items():
        for rank, (s, a, phrase, left, right) in enumerate(sorted(items)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(t, g, 7, "x") for t, g in rows], "text string, lang string, n int, chunk string")
    out = K.collocations(df.repartition(3), **how)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "eps", "zeta", "é", "ß漢", "(x)", "new", "york", "city"]
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "  ", "\t", "\x0b"]) for _ in range(rng.randint(0, 60)))
        out.append((t + " new york city hall" * (i % 3), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("how", [{}, {"every": 1}, {"every": 10**9}, {"least": 40, "top": 5, "every": 2}, {"longest": 2}, {"longest": 5, "least": 3, "every": 3}])
def test_phrases_equal_plain_loops(spark, how):
    rows = texts(4)
    rows += rows[:40] * 3
    kept = {k: v for k, v in how.items() if k != "every"}
    assert mined(spark, rows, **how) == brute(rows, **kept) != []


@pytest.mark.parametrize("rows", [
    [], [(None, "en")], [("", None), (" \t ", "en"), ("...", "de")], [("one word", "en")] * 9, [("one word", "en")] * 10,
    [("a a a a a a a a a a a a a a", "en")], [("x" * 40_000 + " y", "en")] * 10, [("a b c " * 5000, None)],
    [("Ä B. ä b", "de"), ("Ä B\x0cÄ b", "de")] * 5,
])
def test_edge_tables(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_chunks_are_prefix_free_and_own_each_occurrence_once(spark):
    rows = [(t, g) for t, g in texts(8, 80)]
    df = spark.createDataFrame(rows, "text string, lang string")
    parsed = K.chunks(df, "text", "lang", 3, 4).collect()
    words = sum(len(WORD.findall(p)) for t, _ in rows for p in CUT.split(t))
    assert sum(r["words"] for r in parsed) == words
    assert len({(r["lang"], r["opening"], r["chunk"]) for r in parsed}) == len(parsed)
    assert all(len(r["chunk"].split(" ")) > 2 for r in parsed if not r["opening"])
    # the same passage behind other words is cut alike
    again = K.chunks(df.select(F.concat(F.lit("other words here "), "text").alias("text"), "lang"), "text", "lang", 3, 4).collect()
    inner = {r["chunk"] for r in parsed if not r["opening"]}
    assert inner <= {r["chunk"] for r in again}


def test_merged_keeps_unequal_checks_apart():
    first, (n,) = K.merged(np.array([5, 5, 5, 1]), np.array([0, 1, 0, 0]), [np.array([1, 2, 4, 8])])
    assert sorted(zip(first.tolist(), n.tolist())) == [(0, 5), (1, 2), (3, 8)]


def test_full_marks_only_cost_time(spark, monkeypatch):
    rows = texts(6, 120)
    monkeypatch.setattr(K, "marks", lambda *a, **k: np.full(128, 255, np.uint8))
    assert mined(spark, rows) == brute(rows)


def test_common_parts_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(K, "HOT", 1)
    rows = texts(9, 150)
    assert mined(spark, rows) == brute(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 1, "a", 3 * 10**14 + 1), ("en", 1, "b", 2 * 10**14 + 7), ("en", 2, "a b", 10**14 + 3)],
        "lang string, size int, phrase string, n long",
    )
    row = K.scored(counts).first()
    assert row["score"] == 10**6 * (10**14 + 3) ** 2 // ((3 * 10**14 + 1) * (2 * 10**14 + 7))


def test_bins_are_packed_and_marked_exactly(spark, monkeypatch):
    key = np.sort(np.random.default_rng(1).integers(0, 2**40, 5000, dtype=np.uint64))
    n = np.arange(5000) % 300
    back, counts = K._unpacked_bins(K._packed_bins(key, n))
    assert (back == key).all() and (counts == n).all()
    monkeypatch.setattr(K, "FLUSH_ROWS", 50)  # many flushes
    rows = texts(12, 100)
    assert mined(spark, rows) == brute(rows)
