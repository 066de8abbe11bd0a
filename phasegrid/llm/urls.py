"""URL rules by expanded expressions: host suffixes times path prefixes, found by hash prefix.

Only DataFrame functions.  Sites (host, path) are made distinct first, so a hot page is judged
once, and only the shapes that some rule has (label counts, path lengths) are expanded, which
bounds the expansion of a URL of any length without losing a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(sites: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """One row for each host suffix of ``labels`` labels and path prefix of ``lengths`` characters."""
    part = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.filter(F.lit(labels), lambda k: k <= F.size(part)),
        lambda k: F.concat_ws(".", F.slice(part, F.size(part) - k + 1, k)),
    )
    prefixes = F.transform(
        F.filter(F.lit(lengths), lambda k: k <= F.length("path")),
        lambda k: F.substring(F.col("path"), F.lit(1), k),
    )
    return (
        sites.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .select("host", "path", F.concat("suffix", "prefix").alias("expression"))
    )


def digests(df: DataFrame, column: str) -> DataFrame:
    """Adds the full digest of an expression and its first 32 bits, the join key."""
    df = df.withColumn("digest", F.sha2(F.col(column), 256))
    return df.withColumn("short", F.substring("digest", 1, 8))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """``id_col``, host, path, rule and verdict of each row of ``pages``.

    rules: host, path, verdict.  A rule fits its host and all subdomains when the path starts with
    the rule's; the longest expression wins (then the longer host, then ``block``).  No fitting
    rule: rule null, verdict ``default``.  A null or malformed URL has an empty host and path, so
    only a rule with an empty host could fit it.  Rules without a host are dropped, a null path
    counts as empty, hosts are lowered.  Rows keep their number: repeated ids and URLs stay.
    """
    ruled = rules.where(F.col("host").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    )
    ruled = ruled.select("*", F.concat("rule_host", "rule_path").alias("rule"))
    # The shapes of the rules: a few integers, at most one for each length that occurs.
    shape = ruled.agg(
        F.collect_set(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    rows = pages.select(
        F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    if not shape["labels"]:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    spread = digests(expressions(rows.select("host", "path").distinct(), shape["labels"], shape["lengths"]), "expression")
    keyed = digests(ruled, "rule").withColumnRenamed("digest", "rule_digest")
    best = (
        spread.join(keyed, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("rule"), F.length("rule_host"),
                    (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict",
                )
            ).alias("best")
        )
    )
    return rows.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
