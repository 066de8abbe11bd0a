"""Small corpora with the hard cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sto", "ver", "zan") for b in ("dor", "fel", "gim", "hut", "jal")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS)
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus(spark):
    """doc_id, text, lang, source and columns whose names the operators use themselves."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    texts = [*base, base[0], base[1], base[1], None, "", "  \n ", "one", prose(rng, 3), "x" * 30_000, prose(rng, 9_000)]
    for t in base[2:14]:  # near copies
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 7 else None, "clash", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, cls int")
    return df.withColumns({"row_key": F.lit("k"), "_key": F.lit(1), "kept": F.lit("?"), "n": F.lit(1), "size": F.lit("s")})


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)
