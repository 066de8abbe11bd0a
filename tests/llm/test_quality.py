import collections
import math
import random
import re

import numpy as np

from phasegrid.llm import quality as Q

from .conftest import prose


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_figures_equal_plain_loops(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\t#é漢.") for _ in range(rng.randint(0, 200))) for _ in range(80)]
    texts += ["", None, "\n\n", "a\na\na\n", " ".join("x y z".split() * 30), "w " * 5000, "\u2028a b\u00a0c", "|" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", Q.F.lit("en"))
    for r in Q.judge(df).collect():
        want = figures(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_model_is_a_distribution_and_equals_the_formula():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 5, 400).astype(np.uint8)
    keys = Q.gram_keys(codes, np.array([0, 400]))
    grams, counts = np.unique(keys, return_counts=True)
    model = Q.fit(grams, counts)
    assert all(np.all(np.diff(level[0]) > 0) for level in model)
    for context in (0, int(grams[3]) // Q.CLASSES, 47 * 48 * 48 + 46 * 48 + 45):
        every = context * Q.CLASSES + np.arange(Q.CLASSES)
        assert abs(np.exp(Q.log_probs(model, every).astype(float)).sum() - 1) < 1e-4
    # Highest order by hand.
    cut = Q._discounts(counts)
    g = int(grams[10])
    own = counts[grams // Q.CLASSES == g // Q.CLASSES]
    below = Q.fit(grams, counts)[1]
    p3 = math.exp(below[1][np.searchsorted(below[0], g % Q.CLASSES**3)])
    c = int(counts[10])
    want = max(c - cut[min(c, 3)], 0) / own.sum() + cut[np.minimum(own, 3)].sum() / own.sum() * p3
    assert abs(Q.log_probs(model, np.array([g]))[0] - math.log(want)) < 1e-4


def test_bands_keep_prose_and_reject_noise(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 150), "en") for i in range(120)]
    rows += [(500 + i, " ".join("".join(rng.choice("qxjz#%$") for _ in range(7)) for _ in range(150)), "en") for i in range(3)]
    rows += [(600, prose(rng, 150), None)]
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(120)) and kept[600]
    assert not any(kept[500 + i] for i in range(3))


def test_columns_and_empty_table(corpus, empty):
    out = Q.judge(corpus)
    assert out.count() == corpus.count()
    assert len(out.columns) == len(set(out.columns)) and dict(out.dtypes)["kept"] == "boolean"
    assert Q.judge(empty).count() == 0


def test_labelled_junk_goes_and_sound_texts_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.judge(docs.select("doc_id", "text", "lang")).join(labels, "doc_id").where("not base_failed").collect()
    junk, sound = ([r["kept"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(junk) >= 28 and sum(junk) <= 3
    assert len(sound) > 300 and all(sound)


def test_stutters_are_words_like_the_one_before(spark):
    texts = ["a a b b b", "a", "", None, "a b a b"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert [r["n_stutter"] for r in Q.judge(df).orderBy("doc_id").collect()] == [3, 0, 0, 0, 0]


def plain_grams(texts):
    out = collections.Counter()
    for text in texts:
        padded = "   " + (text or "")
        out.update(padded[i : i + 4] for i in range(len(padded) - 3))
    return out


def as_text(r):
    return "".join(map(chr, (r["first"], r["rest"] >> 42, r["rest"] >> 21 & 0x1FFFFF, r["rest"] & 0x1FFFFF)))


def test_every_character_counts_as_itself(spark, monkeypatch):
    rng = random.Random(6)
    # Of one class before: cases, digits, marks, letters 16 code points apart, blanks.
    texts = ["".join(rng.choice("aAbB19;! \n éùЖжцЦ漢漲😀🙀") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts += ["", None, "a", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_grams(texts)
    assert {as_text(r): r["n"] for r in Q.count_grams(df).collect()} == want
    for name in ("TABLE_KEYS", "HELD_GRAMS", "SLICE_BYTES"):
        monkeypatch.setattr(Q, name, 50)
    assert {as_text(r): r["n"] for r in Q.count_grams(df).collect()} == want


def test_invalid_text_is_read_row_by_row():
    rows = [b"a\xc3", b"\xa9b", "é😀".encode(), b"", b"\xff\xfe"]
    off = np.cumsum([0, *map(len, rows)])
    points, at = Q.code_points(np.frombuffer(b"".join(rows), np.uint8), off)
    assert [points[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[97, 0xC3], [98], [0xE9, 0x1F600], [], [0xFF, 0xFE]]


def test_model_tables_equal_the_model_in_one_process(spark):
    rng = np.random.default_rng(3)
    codes = np.minimum(rng.geometric(0.15, 4000), 47).astype(np.uint8)
    grams, counts = np.unique(Q.gram_keys(codes, np.array([0, 4000])), return_counts=True)
    digits = [(grams // Q.CLASSES**k % Q.CLASSES).astype(int) for k in (3, 2, 1, 0)]
    rows = [(int(a), int(b) << 42 | int(c) << 21 | int(d), int(n)) for a, b, c, d, n in zip(*digits, counts)]
    counted = spark.createDataFrame(rows, "first int, rest long, n long")
    got = {(r["first"], r["rest"]): r["log_prob"] for r in Q.kneser_ney(counted, Q.CLASSES).collect()}
    want = Q.log_probs(Q.fit(grams, counts), grams)
    assert len(got) == len(rows)
    assert max(abs(got[r[:2]] - w) for r, w in zip(rows, want)) < 1e-4


def test_model_in_chunks_equals_the_whole_model(spark, corpus, monkeypatch):
    def judged():
        return {(r["doc_id"], r["text"]): (r["log_prob"], r["n_marks"], r["n_words"], r["kept"]) for r in Q.judge(corpus).collect()}

    whole = judged()
    for name, size in (("MAX_GRAMS", 0), ("CHUNK_BYTES", 3000), ("SLICE_BYTES", 1000)):
        monkeypatch.setattr(Q, name, size)
    chunks = judged()
    assert chunks.keys() == whole.keys()
    for key, (log_prob, *others) in whole.items():
        assert abs(chunks[key][0] - log_prob) <= 1e-9 * abs(log_prob) and list(chunks[key][1:]) == others
