"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phasegrid.sources import storage


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for every node of the edges (a, b), two longs.

    Each round hangs all larger neighbours on a node's smallest neighbour, then all smaller ones.
    Rounds end when the edges are stars; their number grows with the logarithm of the longest path.
    Every round is a written table in the shared folder, and joins on a hot node can be split, as
    the other side has one row for each node.  No edges: no rows; loops and repeats do no harm.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        return storage.save(df.where("a <> b").distinct(), storage.new_path(spark, "edges"))

    larger = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = kept(edges.select(*larger))
    mark = _print(now)
    while mark[0]:
        # Large star: every neighbour above u hangs on u's smallest neighbour (or u).
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        now = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: u and its smaller neighbours hang on the smallest of them.
        now = now.distinct()
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        now = kept(
            now.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
        )
        if (after := _print(now)) == mark:
            break
        mark = after
    found = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return found.union(found.select(F.col("label").alias("node"), "label").distinct())
