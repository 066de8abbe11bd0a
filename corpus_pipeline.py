"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from phasegrid.llm import bpe, decontaminate, parity_join, pii, quality
from phasegrid.llm.common import fresh, table
from phasegrid.llm.queries import RANKS
from phasegrid.sources import storage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no clash with the figures' names
    text, lang = (f"c{docs.columns.index(c)}" for c in ("text", "lang"))
    return quality.judge(plain, text, lang).where("kept").select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, that of the smallest id.

    Rows are told apart by id and text, so rows that share an id but not their text are judged each by
    itself.  Of equal rows one stays; texts without a word link with nothing and all stay.
    """
    key, n, group = (fresh(docs, name) for name in ("_row", "_n", "_group"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = storage.save(
        parity_join.link_components(keyed, key).select(
            F.col("doc_id").alias(key), F.col("component_id").alias(group), (F.col("n_shingles") > 0).alias(n)),
        storage.new_path(spark, "row-groups"),
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first")
    best = found.where(n).join(keyed.select(key, "doc_id"), key).groupBy(group).agg(first)
    gone = found.where(n).join(best.select(F.col(f"first.{key}").alias(key)), key, "left_anti").select(key)
    again = found.where(n).groupBy(key).count().where("count > 1").select(key)
    left = keyed.join(gone.distinct(), key, "left_anti")
    once = left.join(again, key, "left_anti").union(left.join(again, key, "left_semi").dropDuplicates([key]))
    return once.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed), their number, and whether decoding gives the text back."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    both = bpe.decode(ids, path, pattern)
    same = F.coalesce(F.col("text").cast("binary"), F.lit(b"")) == F.col("decoded")
    return both.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        same.alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

# Perplexity bands, sketches and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.save(stage(spark, docs, sf_dir), storage.new_path(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)
