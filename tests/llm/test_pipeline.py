"""The pipeline on a small folder, each stage against its operator's brute force."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as CP  # noqa: E402

from .conftest import prose  # noqa: E402
from . import test_decontaminate as TD  # noqa: E402
from . import test_parity_join as TJ  # noqa: E402
from . import test_pii as TP  # noqa: E402
from . import test_quality as TQ  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in CP.STAGES:
        out.append(CP.storage.save(stage(spark, out[-1], SF), CP.storage.new_path(spark, "stage")))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in CP.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "tokens"]
    assert all(df.schema.names == stages[0].schema.names for df in stages[1:5])


def test_quality_takes_the_rejected(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    for i, t in before.items():
        n, _, _, _, repeated = TQ.figures(t or "")
        if n < 20 or 100 * repeated > 30 * n:
            assert i not in after
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    sound = [i for i in good if i in before and not (TQ.figures(before[i])[0] < 20 or 100 * TQ.figures(before[i])[4] > 30 * TQ.figures(before[i])[0])]
    assert sum(i in after for i in sound) >= 0.98 * len(sound)


def test_one_of_each_group_stays(stages):
    want = {i for i, (_, root) in TJ.brute(sorted(texts(stages[1]).items())).items() if i == root}
    assert set(texts(stages[2])) == want


def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, clashing names."""
    long_, a = " ".join(f"w{i} again" for i in range(4000)), " ".join(f"alpha{i}" for i in range(40))
    rows = [
        (1, a, "en", "s", 5), (2, a + " end", "en", "s", 5), (2, a + " end", "en", "s", 5), (2, "other text of this id " * 2, None, None, None),
        (None, None, None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0),
        (None, a, "de", "s", 1), (4, long_, "fr", None, 9), (5, "mail me at x@y.example or +49 30 1234567", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("kept", "n", "_row", "_n", "_group", "row_key", "start", "ids", "cls", "class_id", "band_low")
    for name in names:
        df = df.withColumn(name, CP.F.lit("clash"))
    return df


@pytest.mark.parametrize("stage", [name for name, _ in CP.STAGES])
def test_hard_rows_and_empty_tables(spark, stage):
    df, run = hard(spark), dict(CP.STAGES)[stage]
    out = run(spark, df, SF)
    rows = out.collect()
    assert run(spark, df.limit(0), SF).count() == 0
    if stage == "tokens":
        assert len(rows) == df.count() and all(r["round_trip"] for r in rows)
        return
    assert out.columns == df.columns and all(r["kept"] == "clash" for r in rows)
    found = sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    if stage == "near_duplicates":
        gone = {(2, df.where("doc_id = 2").first()["text"]), (None, df.where("doc_id = 1").first()["text"])}
        want = [(r["doc_id"], r["text"]) for r in df.collect() if (r["doc_id"], r["text"]) not in gone]
        assert found == sorted(want, key=str)
    elif stage == "benchmark_decontamination":
        assert len(rows) == df.count()
    elif stage == "personal_data":
        assert len(rows) == df.count() and not any("x@y" in (r["text"] or "") for r in rows)
    else:
        assert all(r["doc_id"] in (1, 2, 4, None) for r in rows)


def test_no_benchmark_item_stays(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    plain = [" ".join(TD.words(t)) for _, t in items]
    assert not any(p in " ".join(TD.words(t)) for t in after.values() for p in plain)
    gone = [(i, t) for i, t in before.items() if i not in after]
    assert gone and {d for d, _ in TD.brute(gone, items)} == {i for i, _ in gone}


def test_no_personal_data_stays(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert before.keys() == after.keys()
    assert all(not TP.plain(t or "") for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not TP.plain(t or ""))


def test_tokens_round_trip_and_run_agrees(spark, stages):
    rows = stages[5].collect()
    assert len(rows) == len(texts(stages[4])) and all(r["round_trip"] and r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    again = CP.run(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_quality_tells_characters_apart(spark):
    """Letters of random case had the classes of sound prose."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 150), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, "".join(c.upper() if rng.random() < 0.5 else c.lower() for c in prose(rng, 150)), "en", "s", 1) for i in range(3)]
    kept = texts(CP.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF))
    assert set(kept) == set(range(120))
