"""Proportional stratified interleaving of documents into shards (law ``rows``).

Rows are ranked by a seeded hash inside their source, spread over (0, 1) by their fractional rank
and cut into equal runs, so each shard has every source in the proportion of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from phasegrid.sources import storage

# About how many rows one sorting task gets.
ROWS_PER_BUCKET = 100_000


def _offsets(df: DataFrame, keys: list[str], bucket: str, weight: str, name: str) -> DataFrame:
    """Rows that lie in earlier buckets of the same keys; one small row for each bucket."""
    counts = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("_n"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name))


def shards(df: DataFrame, n_shards: int = 24, seed: int = 17, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, text_crc32, position, shard and slot of every row.

    size is the text's UTF-8 bytes plus 8.  Shard sizes differ by one row at most and slots count
    from 0 without gaps.  A null text is empty, a null source a source of its own.  Identical rows
    are counted first and numbered at the end, so no number of them makes a hot group; ties of the
    hash are broken by the row's values.  Fewer rows than shards leave shards empty; an empty
    table gives no rows.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
        (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = storage.save(
        slim.groupBy("_id", "_source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies")),
        storage.new_path(spark, "shard-rows"),
    )
    total = rows.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    bits = max(6, (total // ROWS_PER_BUCKET).bit_length())
    buckets = 1 << bits

    # 1. Rank inside the source: an unsigned hash in buckets of its top bits.
    named = rows.withColumn("_stratum", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("null")))
    hashed = named.withColumn(
        "_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_stratum", "_id", "text_crc32", "size"), 1)
    ).withColumn("_bucket", F.shiftright("_h", 63 - bits) if bits else F.lit(0).cast("long"))
    hashed = storage.save(hashed, storage.new_path(spark, "shard-hashed"))
    inside = W.partitionBy("_stratum", "_bucket").orderBy("_h", "_id", "text_crc32", "size")
    before = F.coalesce(F.sum("_copies").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = hashed.groupBy("_stratum").agg(F.sum("_copies").alias("_of"))
    earlier = _offsets(hashed, ["_stratum"], "_bucket", "_copies", "_earlier").join(sizes, "_stratum")
    ranked = (
        hashed.withColumn("_before", before)
        .join(earlier, ["_stratum", "_bucket"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    )
    # 2. Fractional rank; a phase of the source's own keeps many tiny sources from meeting at 1/2.
    phase = F.pmod(F.xxhash64(F.lit(seed + 1), "_stratum"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ranked = ranked.withColumn(
        "_part", (F.col("_earlier") + F.col("_before") + F.col("_copy") + phase) / F.col("_of")
    ).withColumn("_cell", F.floor(F.col("_part") * buckets))
    ranked = storage.save(
        ranked.select("_id", "_source", "_stratum", "size", "text_crc32", "_h", "_copy", "_part", "_cell",
                      F.lit(1).alias("_one")),
        storage.new_path(spark, "shard-ranked"),
    )
    # 3. Global position and cut.
    order = W.partitionBy("_cell").orderBy("_part", "_stratum", "_h", "_id", "text_crc32", "size", "_copy")
    placed = ranked.withColumn("_row", F.row_number().over(order) - 1).join(
        _offsets(ranked, [], "_cell", "_one", "_first"), "_cell"
    )
    return (
        placed.withColumn("position", (F.col("_first") + F.col("_row")).cast("long"))
        .withColumn("_total", F.lit(max(total, 1)).cast("long"))
        .withColumn("shard", F.expr(f"cast((position * {n_shards}) div _total as int)"))
        .withColumn("slot", F.expr(f"position - (shard * _total + {n_shards - 1}) div {n_shards}"))
        .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "text_crc32",
                "position", "shard", "slot")
    )


def write_shards(assigned: DataFrame, texts: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the texts of uniquely named documents as one folder per shard, ordered by slot."""
    (
        texts.join(assigned.select(id_col, "shard", "slot"), id_col)
        .repartition("shard", F.floor(F.col("slot") / ROWS_PER_BUCKET))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
