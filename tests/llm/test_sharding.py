import zlib
from collections import Counter, defaultdict

from phasegrid.llm import sharding


def check(rows, n_rows, k):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == n_rows
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(i, [])) for i in range(k)]
    assert max(sizes) - min(sizes) <= 1


def test_law_and_columns(corpus):
    rows = sharding.shards(corpus, 5).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in corpus.collect()}
    check(rows, len(texts), 5)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    rows += [(9000 + i, "t", f"single{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.shards(df, 8).collect()
    check(got, len(rows), 8)
    source = {i: s for i, _, s in rows}
    per = Counter((r["shard"], source[r["doc_id"]]) for r in got)
    for name in ("hot", "s0", "s1"):
        counts = [per[i, name] for i in range(8)]
        assert max(counts) - min(counts) <= max(3, 0.06 * sum(counts) / 8)
    singles = [sum(per[i, f"single{j}"] for j in range(120)) for i in range(8)]
    assert max(singles) < 40


def test_repeats_few_rows_and_none(spark, empty):
    same = spark.createDataFrame([(1, "a", None)] * 50 + [(None, None, None)] * 3, "doc_id long, text string, source string")
    check(sharding.shards(same, 4).collect(), 53, 4)
    check(sharding.shards(same.limit(2), 4).collect(), 2, 4)
    assert sharding.shards(empty, 4).count() == 0


def test_the_same_rows_in_any_partitioning(corpus):
    a = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shards(corpus, 6).collect()}
    b = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shards(corpus.repartition(7), 6).collect()}
    assert a == b


def test_written_shards(spark, corpus, tmp_path):
    sharding.write_shards(sharding.shards(corpus, 3), corpus.select("doc_id", "text"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == corpus.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_places_equal_a_plain_ranking(spark, corpus):
    """Sources ranked, spread and cut by plain sorting of the same seeded hashes."""
    from pyspark.sql import functions as F

    more = corpus.select("doc_id", "text", "source").union(corpus.select("doc_id", "text", "source").where("doc_id < 20"))
    text = F.coalesce("text", F.lit(""))
    stratum = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    size, crc = F.octet_length(text).cast("long") + 8, F.crc32(text.cast("binary"))
    rows = more.select(
        stratum.alias("st"), F.col("doc_id").alias("i"), crc.alias("crc"), size.alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(17), stratum, "doc_id", crc, size), 1).alias("h"),
        F.pmod(F.xxhash64(F.lit(18), stratum), F.lit(1 << 20)).alias("phase"),
    ).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["st"]].append(r)
    spread = []
    for st, group in by.items():
        group.sort(key=lambda r: (r["h"], r["i"], r["crc"], r["size"]))
        seen = Counter()
        for rank, r in enumerate(group):
            key = (r["h"], r["i"], r["crc"], r["size"])
            spread.append(((rank + r["phase"] / float(1 << 20)) / len(group), st, *key, seen[key]))
            seen[key] += 1
    n, k = len(rows), 7
    want = sorted(
        (i, crc, p, p * k // n, p - -(-(p * k // n) * n // k)) for p, (_, _, _, i, crc, _, _) in enumerate(sorted(spread))
    )
    got = sorted((r["doc_id"], r["text_crc32"], r["position"], r["shard"], r["slot"]) for r in sharding.shards(more, k).collect())
    assert got == want
