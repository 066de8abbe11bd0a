import random
import re

from pyspark.sql import functions as F

from phasegrid.llm import substring as S

from .conftest import prose


def pieces(text):
    """(first character, words) of each sentence piece, by plain loops."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out = []
    for i, (a, _, w) in enumerate(found):
        fresh = i == 0 or found[i - 1][2][-1] in ".!?" or "\n" in text[found[i - 1][1] : a] or len(out[-1][1]) == S.LONGEST
        if fresh:
            out.append((a, []))
        out[-1][1].append(w)
    return out


def brute(rows):
    seen, out = {}, {}
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in docs:
        p = pieces(t or "")
        for i in range(len(p) - S.RUN + 1):
            run = tuple(tuple(w) for _, w in p[i : i + S.RUN])
            if sum(map(len, run)) >= S.LEAST:
                seen.setdefault(run, (d, t, i))
    for d, t in docs:
        p = pieces(t or "")
        gone = set()
        for i in range(len(p) - S.RUN + 1):
            run = tuple(tuple(w) for _, w in p[i : i + S.RUN])
            if run in seen and seen[run] != (d, t, i):
                gone |= set(range(i, i + S.RUN))
        edge = [a for a, _ in p] + [len(t or "")]
        keep = [(t or "")[: edge[0]]] + [(t or "")[edge[i] : edge[i + 1]] for i in range(len(p)) if i not in gone] if p else [t or ""]
        out[d, t] = "".join(keep)
    return out


def test_equals_plain_loops(spark, corpus):
    rng = random.Random(6)
    passages = [prose(rng, 60) for _ in range(4)]
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect() if len(r["text"] or "") < 20_000]
    rows += [(100 + i, f"{prose(rng, 30)}\n{passages[i % 4]}\n{prose(rng, 30)} é漢.") for i in range(20)]
    rows += [(200, " ".join([passages[0]] * 3)), (201, "É à. " * 40), (202, "a b. c d! e\nf g h. " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash"))
    got = S.deduplicate(df)
    assert got.columns == ["doc_id", "text", "removed"]
    want = brute(rows)
    for r in got.collect():
        original = dict(rows)[r["doc_id"]]
        assert (r["text"] or "") == want[r["doc_id"], original]
        kept, last = [], 0
        for s in r["removed"]:
            kept.append(original[last : s["start"]])
            last = s["end"]
        assert "".join([*kept, (original or "")[last:]]) == (r["text"] or "")


def test_first_stays_and_clean_texts_too(spark, empty):
    rng = random.Random(8)
    shared, own = prose(rng, 60), [prose(rng, 60) for _ in range(3)]
    rows = [(5, shared), (3, f"{own[0]}\n{shared}"), (9, own[1]), (None, None), (4, ""), (7, shared), (7, shared)]
    got = {(r["doc_id"], i): r["text"] for i, r in enumerate(S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect())}
    texts = {}
    for (d, _), t in got.items():
        texts.setdefault(d, []).append(t)
    assert texts[3] == [rows[1][1]] and texts[9] == [own[1]]
    assert texts[5] == [""] and texts[7] == ["", ""] and texts[None] == [None] and texts[4] == [""]
    assert S.deduplicate(empty).count() == 0


def test_every_repeated_stretch_of_fifty_words_loses_half(spark):
    rng = random.Random(12)
    shout = " ".join(rng.choice(["aye!!", "nay!!", "oh!!", "ho!!", "hum!!", "huh!!"]) for _ in range(90))  # one word a sentence
    short = " ".join(f"{w}." if i % 3 == 2 else w for i, w in enumerate(prose(rng, 75).replace(".", "").split()))
    flat = " ".join(f"v{rng.randrange(5000)}" for _ in range(64))  # no end marks
    rows = [(k, " ".join(f"u{k}x{j}" for j in range(3 * k)) + f" {t} " + " ".join(f"z{k}x{j}" for j in range(5)))
            for k, t in enumerate(t for t in (shout, short, flat) for _ in range(5))]
    rows += [(50 + k, f"{prose(rng, 9)} w{k}\n{prose(rng, 40)}") for k in range(10)]
    got = {r["doc_id"]: r for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    seen, repeated = set(), {}
    for d, t in rows:
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        for i in range(len(spans) - 49):
            gram = tuple(t[a:b] for a, b in spans[i : i + 50])
            if gram in seen:
                repeated.setdefault(d, set()).update(spans[i : i + 50])
            seen.add(gram)
    assert len(repeated) == 12
    for d, spans in repeated.items():
        cut = sum(any(s["start"] <= a and b <= s["end"] for s in got[d]["removed"]) for a, b in spans)
        assert cut >= len(spans) / 2, (d, cut, len(spans))
    assert all(got[d]["text"] == t for d, t in rows if d not in repeated)
