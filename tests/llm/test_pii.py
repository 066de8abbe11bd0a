import math
import random
import re

from pyspark.sql import functions as F

from phasegrid.llm import pii

from .conftest import prose

# The contract's patterns, as they stand there.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if good(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


CASES = [
    None, "", "a@b.c_d@e.f", "a@b@c.d", "x..y@-.-", "a@b", "@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.255.000.9", "1.2.3.4x",
    "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "411111111111111", "é漢😀 4111111111111111 é",
    "+1 (555) 123-4567.", "+12", "+1+2+3 555 555 5555", "++49 170 1234567", "+1" + " " * 3000 + "234567890", "1 " * 4000,
    "a" * 60_000, "9" * 60_000, "1-" * 30_000 + "1", "a.b@c.d 1.1.1.1 +4912345678901 4111111111111111",
]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(9)
    made = ["".join(rng.choice("ab.@-+ 0123456789()é_%") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    made += [" ".join(rng.choice(["10.0.0.1", "a.b@c.de", "4012888888881881", "+49 (170) 123-4567", "x"]) for _ in range(9)) for _ in range(40)]
    texts = [*CASES, *made]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.spans_of(df).select("doc_id", pii.span_text(F.col("base")).alias("s")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == plain(t or ""), t


def test_terms_by_the_formula(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30)) for i in range(60)]
    # "captain" stands only beside one address, "often" also elsewhere, "vague" nearly everywhere.
    rows += [(100 + i, f"meet captain often vague jane@x.org today {prose(rng, 4)}") for i in range(5)]
    rows += [(200 + i, f"often vague {prose(rng, 5)}") for i in range(1)] + [(300 + i, f"vague {prose(rng, 5)}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, texts = len(rows), dict(rows)
    holds = lambda w: sum(w in re.findall(r"\w+", t.lower()) for t in texts.values())
    for r in pii.spans_of(df).collect():
        text = texts[r["doc_id"]]
        got = {text[s["start"] : s["end"]]: (s["disclosure"], s["action"]) for s in r["terms"]}
        if "jane" not in text:
            assert not got
            continue
        rate = {w: math.log(n * 5 / (5 * holds(w))) / -math.log(5 / n) for w in ("captain", "often", "vague")}
        assert abs(rate["captain"] - 1) < 1e-12 and abs(got["captain"][0] - 1) < 1e-12 and got["captain"][1] == "remove"
        assert abs(got["often"][0] - rate["often"]) < 1e-12 and got["often"][1] == "generalise"
        assert rate["vague"] < pii.GENERALISE and "vague" not in got
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "captain" not in clean[100] and "[EMAIL]" in clean[100] and " of* " in clean[100] and "vague" in clean[100]
    assert all(clean[i] == t for i, t in rows if "jane" not in t)


def test_hard_rows(spark, corpus, empty):
    rows = [(1, "mail a@b.cd"), (1, "mail a@b.cd"), (1, "other"), (None, "ip 1.2.3.4"), (None, None), (2, "1.2.3.4@x.yz +4912345678901")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_base", F.lit(1))
    assert pii.spans_of(df).count() == 6
    out = pii.sanitise(df)
    assert out.columns == df.columns
    assert sorted((r["text"] or "") for r in out.collect()) == ["", "[EMAIL] [PHONE]", "ip [IP]", "mail [EMAIL]", "mail [EMAIL]", "other"]
    assert pii.sanitise(corpus).count() == corpus.count()
    assert pii.spans_of(empty).count() == pii.sanitise(empty).count() == 0


def test_far_and_shared_clues_go_everywhere(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30)) for i in range(60)]
    # Two documents of one value, the clue far from it and twice; three values of one domain.
    rows += [(100 + i, f"Kestrel {prose(rng, 40)} write to kim@one{i // 2}.net soon {prose(rng, 40)} kestrel.") for i in range(2)]
    rows += [(200 + i, f"u{i}@lone.org {prose(rng, 40)} project halyard {prose(rng, 4)}") for i in range(3)]
    rows += [(300, f"v@single.com once onlyhere {prose(rng, 5)}"), (301, rows[0][1])]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]] for r in pii.spans_of(df).collect()}
    for i in range(2):
        assert terms[100 + i].count("Kestrel") == terms[100 + i].count("kestrel") == 1
    assert all("halyard" in terms[200 + i] for i in range(3))
    assert "onlyhere" not in terms[300]  # one document is no evidence
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert not any("kestrel" in clean[100 + i].lower() or "halyard" in clean[200 + i] for i in range(2))
    assert all(clean[i] == t for i, t in rows if "@" not in t)
