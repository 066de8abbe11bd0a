"""Quality rules and n-gram perplexity bands.

The language model is a modified Kneser-Ney 4-gram model over the characters as they are written, every
code point apart.  Spark counts the 4-grams of every whole text and works out their probabilities as
tables, so the model grows with the corpus.  Up to MAX_GRAMS 4-grams are broadcast; of a larger model each
chunk of texts gets the 4-grams that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from phasegrid.llm import common as C
from phasegrid.sources import storage

ORDER = 4
# All code points; a packed character takes BITS bits, and three of them a long.
ALPHABET, BITS = 0x110000, 21
SPACE = 32
# Symbols of the model in one process (``fit``).
CLASSES = 48
WINDOW = 8
SYMBOLS = "#*$%&|<>"
# Reach of a perplexity band below and above the median of its language, in robust standard deviations.
# Over labelled documents (sf0.1) that pass the base rules, sound ones stay within 3.9 above; below 5 lie 2
# of 3302 of them, and 82 of 301 poor ones lie outside.
BAND_BELOW, BAND_ABOVE = 5.0, 4.0
# Text shapes that a mean over characters dilutes: symbols per word, and words equal to the word before.
SYMBOL_SHARE, STUTTER_SHARE = 0.1, 0.3
# Texts shorter than this many characters scatter more; their deviation is scaled down.
FULL_CHARS = 1500
# Languages up to which their bands are broadcast; with more, Spark's own size check decides.
MAX_BROADCAST_ROWS = 10_000
# Bytes of text measured at once.
SLICE_BYTES = 1 << 20
# 4-grams of a model that is broadcast (20 bytes each), and those that a task holds while it counts.
MAX_GRAMS = HELD_GRAMS = 1 << 21
# Bytes of text that share their part of a larger model.
CHUNK_BYTES = 32 << 20
# Keys that are looked up in a table; more are sorted.
TABLE_KEYS = 1 << 23

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the slice and character offsets by row.

    A row that is not UTF-8 has the value of each lead byte in place of its characters.
    """
    chars = (data & 0xC0) != 0x80
    ends = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    text = data.tobytes()
    begins = off[:-1][off[:-1] < off[1:]]
    try:
        if not chars[begins].all():  # bytes of two rows must not make one character
            raise ValueError("row inside a character")
        points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
    except ValueError:
        points = data[chars].astype(np.uint32)
        for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            try:
                row = text[lo:hi].decode("utf-8")
            except UnicodeDecodeError:
                continue
            points[ends[lo] : ends[hi]] = np.frombuffer(row.encode("utf-32-le"), np.uint32)
    return points, ends[off]


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below ``size``) in order, and the place of each key among them."""
    if size > TABLE_KEYS:
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[keys] = True
    found = np.flatnonzero(seen)
    place = np.empty(size, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[keys]


def text_grams(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 4-grams of a slice (first character; the three after it, packed), and for each
    character the place of the one that ends at it; a text begins after three spaces."""
    n = len(points)
    alphabet, own = _places(np.append(points, np.uint32(SPACE)).astype(np.int64), ALPHABET)
    space, own = own[-1], own[:-1]
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))

    def earlier(back: int) -> np.ndarray:
        out = np.full(n, space, own.dtype)
        out[back:] = own[: n - back]
        out[place < back] = space
        return out

    first = packed = np.zeros(1, np.int64)  # of the n-grams so far
    at = np.zeros(n, np.int64)
    for back in range(ORDER - 1, -1, -1):
        keys, at = _places(at.astype(np.int64) * len(alphabet) + (earlier(back) if back else own), len(first) * len(alphabet))
        before, last = keys // len(alphabet), alphabet[keys % len(alphabet)]
        first, packed = (last, np.zeros(len(keys), np.int64)) if back == ORDER - 1 else (first[before], packed[before] << BITS | last)
    return first, packed, at


GRAM = "first int, rest long"


def _added_up(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by(["first", "rest"]).aggregate([("n", "sum")]).rename_columns(["first", "rest", "n"])


def count_grams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """first, rest, n: counts of all 4-grams of all whole texts, added up task by task, then by Spark."""

    @C.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for _, _, data, off in C.text_slices(batch.column(0), SLICE_BYTES):
                first, rest, at = text_grams(*code_points(data, off))
                held.append(pa.table({
                    "first": pa.array(first, pa.int32()), "rest": pa.array(rest, pa.int64()),
                    "n": pa.array(np.bincount(at, minlength=len(first)), pa.int64()),
                }))
                if sum(map(len, held)) > HELD_GRAMS:
                    held = [_added_up(held)]
                    if len(held[0]) > HELD_GRAMS // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from _added_up(held).to_batches()

    return df.select(F.col(text_col).alias("text")).mapInArrow(count, f"{GRAM}, n long").groupBy("first", "rest").agg(
        F.sum("n").alias("n")
    )


def kneser_ney(counted: DataFrame, alphabet: int = ALPHABET) -> DataFrame:
    """first, rest, log_prob: natural log probability of the last character of each counted 4-gram
    given the three before it (``fit`` as tables)."""
    spark = counted.sparkSession
    levels = [storage.save(counted.select("first", "rest", "n"), storage.new_path(spark, "grams"))]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        shorter = F.col("rest").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("rest")
        levels.append(storage.save(
            levels[-1].groupBy(shorter).agg(F.count("*").alias("n")), storage.new_path(spark, "grams")
        ))
    below = None
    for order in range(1, ORDER + 1):
        level = levels[ORDER - order]
        cuts = _discounts_of(*level.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())
        cut = F.when(F.col("n") == 1, cuts[1]).when(F.col("n") == 2, cuts[2]).otherwise(cuts[3])
        first = ["first"] if order == ORDER else []
        w = Window.partitionBy(*first, F.shiftright("rest", BITS))  # so many rows as characters follow
        total = F.sum("n").over(w)
        rows = level.select(
            *first, "rest", F.col("rest").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("shorter"),
            (F.greatest(F.col("n") - cut, F.lit(0.0)) / total).alias("own"), (F.sum(cut).over(w) / total).alias("freed"),
        )
        if below is None:
            rows = rows.withColumn("below", F.lit(1.0 / alphabet))
        else:
            rows = rows.join(below.hint("merge"), "shorter")
        rows = rows.withColumn("prob", F.col("own") + F.col("freed") * F.col("below"))
        below = rows.select(F.col("rest").alias("shorter"), F.col("prob").alias("below"))
    return rows.select("first", "rest", F.log("prob").cast("float").alias("log_prob"))


def gram_keys(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The packed 4-gram that ends at each of few symbols (CLASSES, 0 a space); a text begins after three spaces."""
    n = len(codes)
    key = codes.astype(np.int32)
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    for back in range(1, ORDER):
        earlier = np.zeros(n, np.int32)
        earlier[back:] = codes[: n - back]
        earlier[place < back] = 0
        key += earlier * CLASSES**back
    return key


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    return np.array(_discounts_of(*(int((counts == k).sum()) for k in (1, 2, 3, 4))))


def _discounts_of(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts from how many n-grams have the counts 1 to 4."""
    if 0 in (n1, n2, n3, n4):  # too few n-grams for an estimate
        return [0.0, 0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(min(max(d, 0.05), 0.95 * k) for k, d in enumerate(found, 1))]


def fit(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The model of few symbols in one process, which ``kneser_ney`` is tested against.

    Sorted arrays of each order, highest first: n-grams, their log probabilities, contexts, and the
    contexts' log back-off weights.
    """
    levels = [(grams.astype(np.int64), counts.astype(np.int64))]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        shorter, n = np.unique(levels[-1][0] % CLASSES**order, return_counts=True)
        levels.append((shorter, n))
    out: list[tuple[np.ndarray, ...]] = []
    prob_below = keys_below = None
    for order in range(1, ORDER + 1):
        keys, n = levels[ORDER - order]
        context, inverse = np.unique(keys // CLASSES, return_inverse=True)
        total = np.bincount(inverse, n)
        cut = _discounts(n)[np.minimum(n, 3)]
        freed = np.bincount(inverse, cut) / total
        if order == 1:
            below = np.full(len(keys), 1.0 / CLASSES)
        else:
            below = prob_below[np.searchsorted(keys_below, keys % CLASSES ** (order - 1))]
        prob = np.maximum(n - cut, 0) / total[inverse] + freed[inverse] * below
        out.append((
            keys.astype(np.int32), np.log(prob).astype(np.float32),
            context.astype(np.int32), np.log(freed).astype(np.float32),
        ))
        prob_below, keys_below = prob, keys
    return out[::-1]


def log_probs(model: list, keys: np.ndarray) -> np.ndarray:
    """Natural log probability of each symbol given the three before it, by a model of ``fit``."""
    out = np.zeros(len(keys), np.float32)
    open_ = np.arange(len(keys))
    for level, (known, logp, contexts, backoff) in enumerate(model):
        order = ORDER - level
        if len(open_) == 0 or len(known) == 0:
            break
        look = keys[open_] % CLASSES**order
        at = np.minimum(np.searchsorted(known, look), len(known) - 1)
        hit = known[at] == look
        out[open_[hit]] += logp[at[hit]]
        open_, look = open_[~hit], look[~hit]
        if len(open_):
            context = look // CLASSES
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            out[open_] += np.where(contexts[at] == context, backoff[at], 0)
    out[open_] += np.float32(-np.log(CLASSES))
    return out


def _repeats(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a run of WINDOW words found twice or more in that row."""
    runs, first, row = C.run_hashes(words, off, WINDOW)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(runs):
        _, inverse, n = np.unique(C.mix(runs + row.astype(np.uint64) * C.BASE), return_inverse=True, return_counts=True)
        again = first[n[inverse] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    return C.per_row(np.cumsum(covered[:-1]) > 0, off)


def _stutters(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each row that equal the word before them."""
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[off[:-1][off[:-1] < len(words)]] = False
    return C.per_row(same, off)


def _equal_lines(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines of each row that have a word and equal an earlier line of the row."""
    solid = np.concatenate([[0], np.cumsum(~C.IS_SPACE[data], dtype=np.int64)])
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], cuts + 1]))
    row = np.searchsorted(off, starts, "right") - 1
    # A line ends at the next line feed or at the end of its row.
    nxt = np.append(cuts, len(data))[np.searchsorted(cuts, starts)]
    ends = np.minimum(nxt, np.append(off[1:], len(data))[np.minimum(row, len(off) - 1)])
    keep = (row < len(off) - 1) & (ends > starts)
    starts, ends, row = starts[keep], ends[keep], row[keep]
    keep = solid[ends] > solid[starts]
    starts, ends, row = starts[keep], ends[keep], row[keep]
    lines = C.mix(C.span_hashes(data, starts, ends) + row.astype(np.uint64) * C.BASE)
    _, first = np.unique(lines, return_index=True)
    n = len(off) - 1
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_marks")]
    + [T.StructField("log_prob", T.DoubleType())]
)


def _lookup(first: np.ndarray, rest: np.ndarray, log_prob: np.ndarray) -> tuple[np.ndarray, ...]:
    """The known three last characters in order; keys of the 4-grams in order, and their log probabilities."""
    known = np.unique(rest)
    keys = np.searchsorted(known, rest) << BITS | first
    order = np.argsort(keys)
    return known, keys[order], log_prob[order]


def _looked_up(model: tuple[np.ndarray, ...], first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Log probabilities of 4-grams; one that was not counted has the share of any character."""
    known, keys, log_prob = model
    out = np.full(len(first), -np.log(ALPHABET))
    if len(keys):
        at = np.minimum(np.searchsorted(known, rest), len(known) - 1)
        look = at << BITS | first
        place = np.minimum(np.searchsorted(keys, look), len(keys) - 1)
        hit = (known[at] == rest) & (keys[place] == look)
        out[hit] = log_prob[place[hit]]
    return out


def _figures(data: np.ndarray, off: np.ndarray, model: tuple[np.ndarray, ...]) -> list[pa.Array]:
    """The columns MEASURES of a slice."""
    starts, ends, words = C.word_spans(data, off)
    solid = ~C.IS_SPACE[data]
    hashes = C.span_hashes(data, starts, ends)
    points, marks = code_points(data, off)
    first, rest, at = text_grams(points, marks)
    logp = np.concatenate([[0.0], np.cumsum(_looked_up(model, first, rest)[at], dtype=np.float64)])
    found = [
        np.diff(words), C.per_row(solid & ((data & 0xC0) != 0x80), off), C.per_row(_SYMBOL[data], off),
        _equal_lines(data, off), _repeats(hashes, words), _stutters(hashes, words), np.diff(marks),
    ]
    return [*(pa.array(x, pa.int64()) for x in found), pa.array(logp[marks[1:]] - logp[marks[:-1]])]


def measure(df: DataFrame, model: DataFrame, text_col: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """All rows and columns of ``df`` and the rule figures and log probability of each text.

    ``model``: a written table of ``kneser_ney`` over the same texts.  A null text counts as empty and
    has figures of 0.  ``names`` renames added columns that would clash with columns of ``df``.
    """
    names = {f.name: (names or {}).get(f.name, f.name) for f in MEASURES}
    schema = T.StructType(df.schema.fields + [T.StructField(names[f.name], f.dataType) for f in MEASURES])
    at_text = df.columns.index(text_col)
    if model.count() > MAX_GRAMS:
        return _measure_by_chunk(df, model, at_text, schema)
    grams = model.toArrow()
    shared = df.sparkSession.sparkContext.broadcast(_lookup(*(grams[c].to_numpy() for c in ("first", "rest", "log_prob"))))

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in C.text_slices(batch.column(at_text), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *_figures(data, off, shared.value)], schema.names)

    return df.mapInArrow(run, schema)


def _measure_by_chunk(df: DataFrame, model: DataFrame, at_text: int, schema: T.StructType) -> DataFrame:
    """``measure`` by a model that no worker holds: each chunk of texts meets the 4-grams that it has."""
    spark, text = df.sparkSession, df.columns[at_text]
    chunk, first, rest, log_prob = own = [C.fresh(df, name) for name in ("_chunk", "_first", "_rest", "_log_prob")]
    numbered = T.StructType([T.StructField(chunk, T.LongType()), *df.schema.fields])

    @C.tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo, hi, data, _ in C.text_slices(batch.column(at_text), SLICE_BYTES):
                if held and held + len(data) > CHUNK_BYTES:
                    now, held = now + 1, 0
                held += len(data)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, now)), *part.columns], numbered.names)

    @C.tidy
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for lo, hi in _stretches(numbers):
                for _, _, data, off in C.text_slices(batch.column(1).slice(lo, hi - lo), SLICE_BYTES):
                    a, r, _ = text_grams(*code_points(data, off))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), numbers[lo])), pa.array(a, pa.int32()), pa.array(r)], ["chunk", "first", "rest"]
                    )

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for batch in batches:
            numbers, is_gram = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi in _stretches(numbers * 2 + is_gram):
                rows = batch.slice(lo, hi - lo)
                if numbers[lo] != now:
                    now, held, part = numbers[lo], [], None
                if is_gram[lo]:
                    held.append([rows.column(i).to_numpy() for i in (1, 2, 3)])
                    continue
                if part is None:
                    part = _lookup(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, np.int64),) * 3
                    held = []
                for a, b, data, off in C.text_slices(rows.column(len(own) + at_text), SLICE_BYTES):
                    columns = rows.slice(a, b - a).columns[len(own) :]
                    yield pa.RecordBatch.from_arrays([*columns, *_figures(data, off, part)], schema.names)

    keyed = storage.save(df.mapInArrow(number, numbered), storage.new_path(spark, "text-chunks"))
    asked = keyed.select(chunk, text).mapInArrow(grams, f"chunk long, {GRAM}").distinct()
    parts = asked.join(model.hint("merge"), ["first", "rest"]).select(
        F.col("chunk").alias(chunk), F.col("first").alias(first), F.col("rest").alias(rest), F.col("log_prob").alias(log_prob)
    )
    rows = parts.unionByName(keyed, allowMissingColumns=True).select(*own, *df.columns)
    # The 4-grams of a chunk come before its texts.
    return rows.repartition(chunk).sortWithinPartitions(chunk, F.col(first).isNull()).mapInArrow(run, schema)


def _stretches(keys: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal keys."""
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _small(by_language: DataFrame) -> DataFrame:
    """A written table of one row a language; broadcast while it is small, whatever Spark guesses."""
    spark = by_language.sparkSession
    written = storage.save(by_language, storage.new_path(spark, "languages"))
    return F.broadcast(written) if written.count() <= MAX_BROADCAST_ROWS else written


def judge(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns of ``df`` with the rule figures, ``base_failed``, ``cross_entropy``
    (nats a character), ``band_low``, ``band_high`` and ``kept``.

    Base: fewer than 20 words, or over 30 % of them in repeated 8-word windows.  The method: the
    deviation of a text's cross-entropy from the median of its language (null: one language of its
    own), scaled by sqrt(characters / FULL_CHARS) for shorter texts, must lie within BAND_BELOW and
    BAND_ABOVE robust standard deviations.  Median and deviation come from all texts of the language
    that pass the base rules.  A text with more than SYMBOL_SHARE symbols a word, or more than
    STUTTER_SHARE of words equal to the word before, is rejected too.  Added columns replace
    columns of the same name.  Empty tables give no rows.
    """
    spark = df.sparkSession
    added = [*MEASURES.names, "base_failed", "cross_entropy", "band_low", "band_high", "kept"]
    df = df.select(*[c for c in df.columns if c not in added])
    model = storage.save(kneser_ney(count_grams(df, text_col)), storage.new_path(spark, "model"))
    rows = storage.save(measure(df, model, text_col), storage.new_path(spark, "quality-rows"))
    rows = rows.withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    ).withColumn("cross_entropy", -F.col("log_prob") / F.greatest("n_marks", F.lit(1)))
    lang, mid, sd = (C.fresh(df, name) for name in ("_lang", "_mid", "_sd"))
    rows = rows.withColumn(lang, F.coalesce(F.concat(F.lit("l"), F.col(lang_col)), F.lit("null")))
    usable = rows.where(~F.col("base_failed")).select(
        lang, "cross_entropy", F.sqrt(F.least(F.col("n_marks") / FULL_CHARS, F.lit(1.0))).alias("_scale")
    )
    middle = _small(usable.groupBy(lang).agg(F.percentile_approx("cross_entropy", 0.5, 10000).alias(mid)))
    spread = _small(
        usable.join(middle, lang)
        .select(lang, mid, (F.abs(F.col("cross_entropy") - F.col(mid)) * F.col("_scale")).alias("_dev"))
        .groupBy(lang).agg(
            F.first(mid).alias(mid), (1.4826 * F.percentile_approx("_dev", 0.5, 10000)).alias(sd))
    )
    plain = (F.col("n_symbols") <= SYMBOL_SHARE * F.col("n_words")) & (F.col("n_stutter") <= STUTTER_SHARE * F.col("n_words"))
    unit = F.greatest(sd, F.lit(1e-3)) / F.sqrt(F.least(F.greatest("n_marks", F.lit(1)) / FULL_CHARS, F.lit(1.0)))
    return (
        rows.join(spread, lang, "left")
        .withColumn("band_low", F.col(mid) - BAND_BELOW * unit)
        .withColumn("band_high", F.col(mid) + BAND_ABOVE * unit)
        .withColumn("kept", ~F.col("base_failed") & plain & F.coalesce(F.col("cross_entropy").between(F.col("band_low"), F.col("band_high")), F.lit(True)))
        .drop(lang, mid, sd)
    )
