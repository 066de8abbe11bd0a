"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, verification.

Only DataFrame functions.  Windows have the size of an item.  Anchors are an item's rarest shingles
with more than a quarter of its weight, so a window of similarity 3/4 or more holds at least one.
Where an anchor stands in a document, the window may start where the item would start, or as many
words before or behind it as insertions and deletions of such a window can shift it: all these
starts are fingerprinted, equal windows once.  Fingerprints have 8 blocks of 16 bits; two that differ
in at most 31 bits differ in at most 3 of some block, so items are entered under all values within
3 bits of each of their blocks and windows look up their own.  Exact weighted-shingle similarity
then decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from phasegrid.llm.common import fresh
from phasegrid.sources import storage

WORDS = 5
BLOCKS, BLOCK_BITS = 8, 16
FLIPS = 3  # bits of a block that may differ
RADIUS = BLOCKS * (FLIPS + 1) - 1
MASKS = [sum(1 << b for b in bits) for k in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), k)]
SIMILAR = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words between white space, A-Z lowered; none for null or blank."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(F.translate(bare, UPPER, LOWER), r"[\x20\x09-\x0D]+", -1)
    )


def shingle_rows(df: DataFrame, words: str, *keep: str) -> DataFrame:
    """One row for each run of five words: ``keep``, pos (from 0), h and weight (its characters)."""
    ahead = [F.slice(F.col(words), k + 1, F.greatest(F.size(words) - WORDS + 1, F.lit(0))).alias(f"w{k}") for k in range(WORDS)]
    zipped = df.select(*keep, F.posexplode(F.arrays_zip(*ahead)).alias("pos", "w"))
    parts = [F.col(f"w.w{k}") for k in range(WORDS)]
    return zipped.select(*keep, "pos", F.xxhash64(*parts).alias("h"), sum((F.length(p) for p in parts[1:]), F.length(parts[0])).alias("weight"))


def _window_shingles(words: Column) -> Column:
    """array<struct<h, weight>> of a window's runs of five words."""
    n = F.size(words) - WORDS + 1

    def one(i: Column) -> Column:
        parts = [F.element_at(words, i + k) for k in range(WORDS)]
        return F.struct(F.xxhash64(*parts).alias("h"), sum((F.length(p) for p in parts[1:]), F.length(parts[0])).alias("weight"))

    empty = F.array().cast("array<struct<h:bigint,weight:int>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one)).otherwise(empty)


def fingerprint(shingles: Column) -> Column:
    """Weighted SimHash as an array of 8 blocks of 16 bits."""
    both = F.transform(shingles, lambda s: F.struct(
        s["h"].alias("a"), F.xxhash64(s["h"]).alias("b"), s["weight"].alias("weight")))

    def bit(j: Column, k: int) -> Column:
        place = (j * BLOCK_BITS + k) % 64

        def vote(acc: Column, s: Column) -> Column:
            half = F.when(j < BLOCKS // 2, s["a"]).otherwise(s["b"])
            one = F.call_function("shiftright", half, place.cast("int")).bitwiseAND(F.lit(1)) == 1
            return acc + F.when(one, s["weight"]).otherwise(-s["weight"])

        return F.when(F.aggregate(both, F.lit(0), vote) >= 0, 1 << k).otherwise(0)

    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda j: sum((bit(j, k) for k in range(1, BLOCK_BITS)), bit(j, 0)))


def shift_of(size: Column) -> Column:
    """Words by which insertions and deletions can move a window of similarity 3/4: they cost a seventh
    of its shingles at most; a sixth leaves room for uneven weights."""
    return F.floor((size - WORDS + 1) / 6).cast("int") + 1


def candidate_pairs(contents: DataFrame, marked: DataFrame) -> DataFrame:
    """content, item: pairs of one size that share a block up to FLIPS bits."""
    left = contents.select("content", "size", F.posexplode("blocks").alias("block", "bits"))
    own = marked.select("item", "size", F.posexplode("item_blocks").alias("block", "own"))
    right = own.withColumn("mask", F.explode(F.array(*map(F.lit, MASKS)))).select(
        "item", "size", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("bits"))
    # Sorted and merged: Spark guesses the size of neither side, and both may be large.
    return left.hint("merge").join(right, ["size", "block", "bits"]).select("content", "item").distinct()


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def item_classes(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (the smallest id), words and size of each distinct item of five words or more."""
    return (
        items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words"))
        .where(F.size("words") >= WORDS)
        .groupBy("words").agg(F.min("item").alias("item"))
        .select("item", "words", F.size("words").alias("size"))
    )


def anchors(classes: DataFrame) -> DataFrame:
    """h, pos, size: the rarest shingles of each item that carry over a quarter of its weight."""
    rows = shingle_rows(classes, "words", "item", "size")
    df = rows.groupBy("h").agg(F.count_distinct("item").alias("df"))
    item = W.partitionBy("item")
    order = item.orderBy("df", "h", "pos").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(df, "h")
        .withColumn("before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("total", F.sum("weight").over(item))
        .where(F.col("before") <= (1 - SIMILAR) * F.col("total"))
        .select("h", F.col("pos").alias("item_pos"), "size").distinct()
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """row_key, id, item, start, n_words and similarity of the best window for each document and
    item with a window of similarity 0.75 or more.

    Similarity: weighted Jaccard of the multisets of five-word shingles, a shingle weighing its
    characters.  Equal items count once, under the smallest id.  Items of fewer than five words
    are no evidence and never match; null or empty texts match nothing; row_key names equal
    (id, text) rows.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    classes = storage.save(item_classes(items, item_id, item_text), storage.new_path(spark, "items"))
    slim = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("row_key"),
        F.col(text_col).alias("_text"),
    )
    spread = shingle_rows(slim.select("row_key", words_of(F.col("_text")).alias("words")), "words", "row_key")
    # Written first, so that Spark knows its size: a small benchmark is broadcast before any shuffle
    # of the documents' shingles is planned, a large one is not.
    wanted = storage.save(anchors(classes), storage.new_path(spark, "anchors"))
    places = (
        spread.select("row_key", "pos", "h").join(wanted, "h")
        .select("row_key", F.struct((F.col("pos") - F.col("item_pos")).alias("start"), "size").alias("place"))
        .groupBy("row_key").agg(F.collect_set("place").alias("places"))
    )
    around = lambda p: F.transform(
        F.sequence(F.greatest(p["start"] - shift_of(p["size"]), 1 - p["size"]), p["start"] + shift_of(p["size"])),
        lambda start: F.struct(start.alias("start"), p["size"].alias("size")),
    )
    places = places.select("row_key", F.array_distinct(F.flatten(F.transform("places", around))).alias("places"))
    places = storage.save(places, storage.new_path(spark, "places"))
    first = F.greatest(F.col("place.start"), F.lit(0))
    windows = slim.join(places, "row_key").select(
        "row_key", "_id", words_of(F.col("_text")).alias("words"), F.explode("places").alias("place")
    )
    windows = windows.select(
        "row_key", "_id", first.alias("start"), F.col("place.size").alias("size"),
        F.slice("words", first + 1, F.col("place.size") + F.least(F.col("place.start"), F.lit(0))).alias("window"),
    )
    windows = storage.save(
        windows.withColumn("content", F.xxhash64("window", "size")), storage.new_path(spark, "windows")
    )
    contents = windows.groupBy("content", "size").agg(F.first("window").alias("window"))
    contents = storage.save(
        contents.select("content", "size", _window_shingles(F.col("window")).alias("shingles"))
        .withColumn("blocks", fingerprint(F.col("shingles"))), storage.new_path(spark, "contents")
    )
    marked = storage.save(
        classes.select("item", "size", _window_shingles(F.col("words")).alias("shingles"))
        .withColumn("item_blocks", fingerprint(F.col("shingles"))), storage.new_path(spark, "item-prints")
    )
    pairs = (
        candidate_pairs(contents, marked)
        .join(contents.select("content", "blocks"), "content").join(marked.select("item", "item_blocks"), "item")
        .where(_distance("blocks", "item_blocks") <= RADIUS).select("content", "item")
    )

    def counted(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key, F.explode("shingles").alias("s")).groupBy(key, "s.h", "s.weight").agg(
            F.count(F.lit(1)).alias(name))

    def total(column: str) -> Column:
        return F.aggregate(column, F.lit(0), lambda acc, s: acc + s["weight"])

    common = (
        pairs.join(counted(contents, "content", "n_a"), "content")
        .join(counted(marked, "item", "n_b"), ["item", "h", "weight"])
        .groupBy("content", "item").agg(F.sum(F.col("weight") * F.least("n_a", "n_b")).alias("common"))
    )
    scored = (
        common.join(contents.select("content", total("shingles").alias("all_a")), "content")
        .join(marked.select("item", total("shingles").alias("all_b")), "item")
        .withColumn("similarity", F.col("common") / (F.col("all_a") + F.col("all_b") - F.col("common")))
        .where(F.col("similarity") >= SIMILAR)
        .select("content", "item", "similarity")
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("best")
    return (
        windows.select("row_key", "_id", "start", "size", "content").join(scored, "content")
        .groupBy("row_key", "_id", "item").agg(best)
        .select("row_key", F.col("_id").alias(id_col), "item", (-F.col("best.back")).alias("start"),
                F.col("best.size").alias("n_words"), F.col("best.similarity").alias("similarity"))
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are."""
    name = fresh(docs, "_key")
    found = contaminated(docs, items, id_col, text_col).select(F.col("row_key").alias(name)).distinct()
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn(name, key).join(found, name, "left_anti").select(*docs.columns)
