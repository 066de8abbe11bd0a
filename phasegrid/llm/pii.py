"""Personal data: pattern spans, and terms that the corpus shows to give protected values away.

Only DataFrame functions.  Base spans come from patterns.  The method then protects each found value,
the group it belongs to (mail domain, network, issuer, dialling code) and its kind as entities.  Every
word of a document is a possible clue to the entities in it: with counts of distinct texts over the
whole corpus, disclosure = PMI(entity, term) / information(entity).  It is 1 when the term never
occurs without the entity.  The decision takes n - 1 / n for the n texts of a pair, so one text is no
evidence and few are less than many.  Every occurrence of a clue above the thresholds is generalised
(cut to a prefix) or removed in all documents of its entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phasegrid.llm.common import fresh
from phasegrid.sources import storage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Where a match may begin: at the end of the match before, or not inside a run of the same
# characters (a match that fails at the begin of a run fails at every later place in it).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GAP = r"[^\p{L}\p{N}]+"
# Shorter words are no clues; disclosure from which a clue is cut or removed.
SHORTEST, GENERALISE, REMOVE = 3, 0.75, 0.95
SPAN = "struct<start:int,no:int,end:int,kind:string,value:string>"


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, hit>> of all matches, in code points, ends exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    return F.when(F.rlike(text, pattern), F.aggregate(pairs, start, step, lambda acc: acc["found"])).otherwise(empty)


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.translate(hit, " -", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(hit, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans in order of start, then kind."""
    def of(no: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["hit"]))
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(no).alias("no"), m["end"].alias("end"),
            F.lit(kind).alias("kind"), F.lower(m["hit"]).alias("value"),
        ))

    parts = [of(no, kind) for no, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def term_key(term: Column) -> Column:
    return F.xxhash64(F.lower(term))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, GAP, -1), lambda w: F.length(w) >= SHORTEST))


def _outside(found: Column, spans: Column) -> Column:
    return F.filter(found, lambda c: ~F.exists(spans, lambda s: (c["start"] < s["end"]) & (s["start"] < c["end"])))


def entities(spans: Column) -> Column:
    """Distinct hashes of the values, their groups and their kinds."""

    def of(s: Column) -> Column:
        value = s["value"]
        group = (
            F.when(s["kind"] == "email", F.substring_index(value, "@", -1))
            .when(s["kind"] == "ip", F.substring_index(value, ".", 3))
            .otherwise(F.substring(F.translate(value, "+ ().-", ""), 1, 6))
        )
        return F.array(F.xxhash64(s["kind"], value), F.xxhash64(s["kind"], F.lit("group"), group), F.xxhash64(s["kind"]))

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def find(df: DataFrame, text: Column, key: Column) -> DataFrame:
    """All columns of ``df``, ``_key``, ``_spans``, ``_copy`` (names equal texts) and ``_body`` (the text
    where it has spans)."""
    body = F.coalesce(text, F.lit(""))
    out = df.withColumn("_key", key).withColumn("_spans", base_spans(body)).withColumn("_copy", F.xxhash64(body))
    return out.withColumn("_body", F.when(F.size("_spans") > 0, body))


def _rest(text: Column, spans: Column) -> Column:
    """The text without its spans, a space for each."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(" ")).alias("out"),
    ), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def clues(found: DataFrame) -> DataFrame:
    """_copy, entities, terms of each distinct text with an entity that another text has too."""
    spark = found.sparkSession
    marked = found.where(F.size("_spans") > 0).select("_copy", F.explode(entities(F.col("_spans"))).alias("entity")).distinct()
    again = marked.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where("n_e > 1")
    own = marked.join(again, "entity").groupBy("_copy").agg(
        F.collect_list(F.struct("entity", "n_e")).alias("entities"))
    words = F.transform(_words(_rest(F.col("_body"), F.col("_spans"))), term_key)
    texts = found.where(F.size("_spans") > 0).dropDuplicates(["_copy"])
    out = texts.join(own, "_copy").select("_copy", "entities", F.array_distinct(words).alias("terms"))
    return storage.save(out, storage.new_path(spark, "pii-clues"))


def _pairs(clues_: DataFrame) -> DataFrame:
    return clues_.select("_copy", F.explode("entities").alias("e"), "terms").select(
        "_copy", "e.entity", "e.n_e", F.explode("terms").alias("term"))


def disclosures(clues_: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """entity, term, disclosure and ``sure`` (the same from n_et - 1 / n_et) of every clue that two
    texts show together with its entity.

    Counts are numbers of distinct texts over the whole corpus.
    """
    bodies = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    bodies = bodies.withColumn("_copy", F.xxhash64("_text")).dropDuplicates(["_copy"])
    n = texts.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).distinct().count()
    pairs = _pairs(clues_).groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") > 1)
    terms = bodies.select(F.explode(F.array_distinct(F.transform(_words(F.col("_text")), term_key))).alias("term")).groupBy(
        "term").agg(F.count(F.lit(1)).alias("n_t"))

    def rate(n_et: Column) -> Column:
        return F.log(n * n_et / (F.col("n_e") * F.col("n_t"))) / -F.log(F.col("n_e") / n)

    return pairs.join(terms, "term").where(F.col("n_e") < n).select(
        "entity", "term", rate(F.col("n_et")).alias("disclosure"), rate(F.col("n_et") - 1 / F.col("n_et")).alias("sure"))


def spans_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """id, ``row_key``, ``base`` and ``terms`` of every row.

    base: spans of the patterns, by start, then kind in the listed order; kinds may overlap.
    terms: struct(start, end, disclosure, action) of the method, action ``generalise`` or
    ``remove``; they never overlap a base span.  A null text is empty and has no spans.  row_key
    names equal (id, text) rows, which have equal spans; such rows stay as often as they come.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    key = F.xxhash64("_id", F.coalesce("_text", F.lit("")))
    found = storage.save(
        find(docs, F.col("_text"), key).select("_id", "_key", "_spans", "_copy", "_body"), storage.new_path(spark, "pii-spans")
    )
    shown = clues(found)
    # Written, so that Spark knows its size and broadcasts a small one.
    risky = storage.save(
        disclosures(shown, docs, "_text").where(F.col("sure") >= generalise), storage.new_path(spark, "pii-risky")
    )
    told = (
        _pairs(shown).join(risky, ["entity", "term"])
        .groupBy("_copy", "term").agg(F.max(F.struct("sure", "disclosure")).alias("most"))
        .groupBy("_copy").agg(F.map_from_entries(F.collect_list(F.struct("term", "most"))).alias("_risky"))
    )
    some = found.where(F.size("_spans") > 0).join(told, "_copy").withColumn("_forms", F.filter(
        _words(F.col("_body")), lambda w: F.map_contains_key("_risky", term_key(w)))).where(F.size("_forms") > 0)
    # Words hold letters and digits only, so they stand for themselves in a pattern.
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("_forms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    at = _outside(matches(F.col("_body"), pattern), F.col("_spans"))

    def judged(m: Column) -> Column:
        most = F.element_at("_risky", term_key(m["hit"]))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), most["disclosure"].alias("disclosure"),
                        F.when(most["sure"] >= remove, "remove").otherwise("generalise").alias("action"))

    terms = some.dropDuplicates(["_key"]).select("_key", F.transform(at, judged).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double,action:string>>")
    return found.drop("_body").join(terms, "_key", "left").select(
        F.col("_id").alias(id_col), F.col("_key").alias("row_key"), F.col("_spans").alias("base"),
        F.coalesce("terms", none).alias("terms"),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_spans(base: Column, terms: Column) -> Column:
    """Base and method spans by start, then kind."""
    own = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["kind"].alias("kind")))
    more = F.transform(terms, lambda s: F.struct(
        s["start"].alias("start"), F.lit(len(KINDS)).alias("no"), s["end"].alias("end"), F.lit(TERM).alias("kind")))
    return F.array_sort(F.concat(own, more))


def redact(text: Column, base: Column, terms: Column) -> Column:
    """The text with values replaced by [KIND], clues cut to two characters and *, or removed."""
    # Of spans that begin together the longest counts; one that begins inside another is covered.
    own = F.transform(base, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    more = F.transform(terms, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"),
        F.when(s["action"] == "remove", F.lit("[REMOVED]"))
        .otherwise(F.concat(F.substring(text, s["start"] + 1, F.lit(2)), F.lit("*"))).alias("by")))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        F.array_sort(F.concat(own, more)), start, step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(base) + F.size(terms) > 0, done).otherwise(text)


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with the text redacted; a null text stays null."""
    spans = spans_of(df, id_col, text_col).where(F.size("base") > 0).select("row_key", "base", "terms")
    key, base, terms = (fresh(df, name) for name in ("_key", "_base", "_terms"))
    spans = spans.dropDuplicates(["row_key"]).withColumnsRenamed({"row_key": key, "base": base, "terms": terms})
    keyed = df.withColumn(key, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    text = F.when(F.col(base).isNotNull(), redact(F.col(text_col), F.col(base), F.col(terms))).otherwise(F.col(text_col))
    return keyed.join(spans, key, "left").withColumn(text_col, text).select(*df.columns)
