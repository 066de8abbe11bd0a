"""The registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phasegrid.llm import (
    bpe, chat, collocations, decontaminate, langid, parity_join, pii, quality, sharding, substring, topk, urls, whitening,
)
from phasegrid.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
# The rules of the URL query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, pattern, keep=["doc_id"])
    both = bpe.decode(ids, path, pattern)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source", "position",
    )


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return cut.select(
        "doc_id", F.size("removed").cast("long").alias("n_spans"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        "text",
    )


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id"
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "part", "role", "rendered")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.spans_of(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(pii.all_spans(F.col("base"), F.col("terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), "start", "n_words", "similarity")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "cross_entropy",
    )


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


OP10_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}
), cut AS (
  SELECT page_id, row_number() OVER () AS row_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), site AS (
  SELECT page_id, row_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), best AS (
  SELECT row_id, arg_max({{'rule': rule_host || rule_path, 'verdict': rule_verdict}},
                         length(rule_host || rule_path)) AS hit
  FROM site JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row_id
)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict
FROM site LEFT JOIN best USING (row_id)
"""


OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{collocations.NO_LANG}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 4) AS sizes(k))
), f AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS n FROM grams GROUP BY ALL
), found AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10
), covered AS (
  SELECT lang, phrase, max(a) AS top FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM found WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT found.* FROM found LEFT JOIN covered USING (lang, phrase) WHERE top IS NULL OR 100 * top < 50 * a
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
), scores AS (
  SELECT c.lang, c.phrase, a, cut, x.n AS l, y.n AS r, 1000000 * a * a // (x.n * y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scores
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1
), total AS (
  SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP13_SQL = """
WITH usable AS (
  SELECT vec_id, row_number() OVER () AS row_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), entries AS (
  SELECT vec_id, row_id, unnest(range(len(embedding))) AS dim,
         unnest([CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding]) AS v
  FROM usable
), scores AS (
  SELECT q.vec_id AS query_id, q.row_id AS query_row, c.vec_id, c.row_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM entries q JOIN entries c ON q.dim = c.dim AND q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
  GROUP BY ALL
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM scores)
WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_sharding": op2_sharding,
        "op3_substring": op3_substring,
        "op4_langid": op4_langid,
        "op5_jaccard": op5_jaccard,
        "op6_chat": op6_chat,
        "op7_pii": op7_pii,
        "op8_quality": op8_quality,
        "op9_decontamination": op9_decontamination,
        "op10_urls": op10_urls,
        "op11_collocations": op11_collocations,
        "op12_whitening": op12_whitening,
        "op13_topk": op13_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_urls": OP10_SQL, "op11_collocations": OP11_SQL, "op13_topk": OP13_SQL}
