"""Phrase collocations over a dictionary of content-triggered chunks (prefix-free parsing).

The words of a piece are cut where a window of ``longest - 1`` words hashes to a trigger: a chunk runs
from one trigger window to the next, both included, so neighbours overlap by one window and every
phrase lies whole inside at least one chunk.  Equal passages are cut alike; Spark adds up the
distinct chunks with their parse frequencies, and phrases are counted inside the distinct chunks
only, weighted.  A phrase that ends inside the leading overlap belongs to the chunk before.

Counting takes three readings of the dictionary.  The first adds up hashed words and word pairs in
bins; bins that reach ``least`` mark a bit array of fixed size (8 MB, broadcast).  The second does so
for longer phrases whose pairs are all marked.  The third counts by text what is marked.  Every
bin holds at least the count of each of its phrases, so no candidate is lost, and all figures are
exact; how full the bit arrays are steers cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from phasegrid.llm import common as C
from phasegrid.sources import storage

LEAST = 10
LONGEST = 3
TOP = 2000
# A longer phrase takes the place of those inside it from this share of their occurrences.
INSIDE_PERCENT = 50
SCORE_UNIT = 1_000_000
NO_LANG = "und"
# One window in so many is a trigger.
TRIGGER_EVERY = 12
MARK_BITS = 1 << 26
SLICE_BYTES = 1 << 20
# Bins that a task holds before it adds them up; half as many distinct ones are sent on.
FLUSH_ROWS = 1 << 22
# Lookups of parts asked for by more candidates than this go through a broadcast of those parts, of
# which there are at most as many as this.
HOT = 10_000

_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[32, 9]] = True
_SECOND = np.random.Generator(np.random.PCG64(11)).integers(1, 2**64, 256, dtype=np.uint64)


def _spans(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of solid bytes (a row's end ends a run), and run offsets by row."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray | None = None) -> pa.Array:
    """Arrow strings of byte spans; where ``gap`` is set, a span and the next are one, a space between."""
    size = ends - starts
    wide = size + (gap if gap is not None else 0)
    begin = np.concatenate([[0], np.cumsum(wide)])
    body = np.full(int(begin[-1]), 32, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    body[at + np.repeat(begin[:-1], size)] = data[at + np.repeat(starts, size)]
    stops = begin if gap is None else begin[np.concatenate([[0], np.flatnonzero(~gap) + 1])]
    offsets = stops.astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])


def merged(key: np.ndarray, check: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """First places of equal (key, check) pairs and the sums of their weights."""
    order = np.lexsort((check, key))
    if not len(order):
        return order, weights
    k, c = key[order], check[order]
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
    return order[head], [np.add.reduceat(w[order], head) for w in weights]


def _lang_seed(langs: pa.Array) -> np.ndarray:
    _, _, data, off = next(C.text_slices(langs, 1 << 62))
    out = np.zeros(len(langs), np.uint64)
    full = np.flatnonzero(np.diff(off))
    out[full] = C.span_hashes(data, off[:-1][full], off[1:][full])
    return out


def chunks(df: DataFrame, text_col: str, lang_col: str, longest: int, every: int) -> DataFrame:
    """lang, opening, chunk, n, words: distinct chunks of all whole texts and how often each occurs.

    ``opening`` marks chunks at the begin of a piece; all others begin with an overlap of
    ``longest - 1`` words.  ``words`` counts the occurrences of words that are not overlap.
    """
    window = longest - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in C.text_slices(batch.column(1), SLICE_BYTES):
                data = C.FOLD[data]
                parts = _CUTS[data]
                starts, ends, at = _spans(~parts & ~_BLANKS[data], off)
                if not len(starts):
                    continue
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                piece = np.cumsum(parts)[starts]
                opens = np.concatenate([[True], (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])])
                heads = np.flatnonzero(opens)
                since = np.arange(len(starts)) - heads[np.cumsum(opens) - 1]
                last = np.concatenate([opens[1:], [True]])
                words = C.span_hashes(data, starts, ends)
                trigger = np.zeros(len(words), np.uint64)
                for j in range(window):
                    trigger[window - 1 :] = C.mix(trigger[window - 1 :] + words[j : len(words) - window + 1 + j] * np.uint64(2 * j + 1))
                stop = last | ((since >= window) & (trigger % np.uint64(every) == 0))
                end = np.flatnonzero(stop)
                opening = since[np.concatenate([[0], end[:-1] + 1])] == 0
                begin = np.where(opening, np.concatenate([[0], end[:-1] + 1]), np.concatenate([[0], end[:-1] + 1]) - window)
                size = end - begin + 1
                first = np.concatenate([[0], np.cumsum(size)])
                member = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(begin, size)
                gap = np.ones(len(member), bool)
                gap[first[1:] - 1] = False
                texts = _strings(data, starts[member], ends[member], gap)
                offsets = np.frombuffer(texts.buffers()[1], np.int32)
                body = np.frombuffer(texts.buffers()[2], np.uint8)
                langs = batch.column(0).slice(lo, hi - lo)
                key = C.span_hashes(body, offsets[:-1], offsets[1:]) + _lang_seed(langs)[row[begin]]
                key = C.mix(key + opening * C.BASE)
                fresh = size - np.where(opening, 0, window)
                kept, (n, fresh) = merged(
                    key, C.span_hashes(body, offsets[:-1], offsets[1:], _SECOND), [np.ones(len(end), np.int64), fresh]
                )
                yield pa.RecordBatch.from_arrays([
                    langs.take(pa.array(row[begin][kept])), pa.array(opening[kept]), texts.take(pa.array(kept)),
                    pa.array(n), pa.array(fresh),
                ], ["lang", "opening", "chunk", "n", "words"])

    rows = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")
    ).mapInArrow(cut, "lang string, opening boolean, chunk string, n long, words long")
    return rows.groupBy("lang", "opening", "chunk").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


class _Grams:
    """Words of a slice of distinct chunks and their runs, each run in the one chunk that owns it."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, off: np.ndarray, window: int):
        self.data, self.langs = data, batch.column(0).slice(lo, hi - lo)
        self.starts, self.ends, self.at = _spans(data != 32, off)
        self.seed = _lang_seed(self.langs)
        self.n = batch.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
        opening = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
        self.overlap = np.where(opening, 0, window)
        self.hashes = C.span_hashes(data, self.starts, self.ends)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word, chunk and ownership of all runs of ``k`` words."""
        key, first, row = C.run_hashes(self.hashes, self.at, k)
        owned = first + k - 1 - self.at[row] >= self.overlap[row]
        return C.mix(key + self.seed[row] + np.uint64(k) * C.BASE), first, row, owned

    def open_pairs(self, array: np.ndarray, total: int) -> np.ndarray:
        """Of each word, whether it begins a marked pair."""
        out = np.zeros(len(self.starts) + 1, bool)
        pair, first, _, _ = self.runs(2)
        out[first] = _marked(array, pair, total)
        return out


def _slices(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[_Grams]:
    for batch in batches:
        for lo, hi, data, off in C.text_slices(batch.column(2), SLICE_BYTES):
            yield _Grams(batch, lo, hi, data, off, window)


def _bin_bits(total: int) -> int:
    """Bits of a bin number: at least 16 bins for every word of the corpus."""
    return max(20, total.bit_length() + 4)


def _packed_bins(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted bins and their counts: differences by byte planes, of which most are zero, compressed."""
    planes = [np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T, n.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return zstandard.compress(b"".join(p.tobytes() for p in planes), 1)


def _unpacked_bins(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    m = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * m].reshape(8, m).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * m :].reshape(4, m).T).view("<u4").ravel().astype(np.int64)


def marks(
    parsed: DataFrame, total: int, least: int, longest: int, sizes: tuple[int, ...], prior=None, bits: int = MARK_BITS
) -> np.ndarray:
    """Bit array (as bytes) of the bins of phrases of ``sizes`` words that occur ``least`` times or more.

    Each task adds up its bins and sends every bucket, a range of bins, one packed sorted array a
    flush; a bucket adds them up and answers with its part of the bit array, which together has
    ``bits`` bits whatever the corpus.  With ``prior`` (a broadcast bit array of words and pairs)
    only phrases all of whose pairs are marked count.
    """
    width = _bin_bits(total)
    drop = np.uint64(64 - width)
    fold = max(0, width - (bits.bit_length() - 1))  # bins that share a bit
    places = 1 << (width - fold)
    buckets = min(1 << max(6, (total >> 20).bit_length()), places // 64)
    share = np.uint64(width - (buckets.bit_length() - 1))

    def send(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = (key >> share).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        data = [_packed_bins(key[a:b], n[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for grams in _slices(batches, longest - 1):
            open_ = grams.open_pairs(prior.value, total) if prior is not None else None
            for k in sizes:
                key, first, row, owned = grams.runs(k)
                if open_ is not None:
                    for j in range(k - 1):
                        owned &= open_[first + j]
                keys.append(key[owned] >> drop)
                counts.append(grams.n[row[owned]])
                waiting += len(keys[-1])
            if waiting > FLUSH_ROWS:
                key, n = _added(keys, counts)
                keys, counts, waiting = [key], [n], len(key)
                if waiting > FLUSH_ROWS // 2:
                    yield send(key, np.minimum(n, least))
                    keys, counts, waiting = [], [], 0
        if waiting:
            key, n = _added(keys, counts)
            yield send(key, np.minimum(n, least))

    def add(table: pa.Table) -> pa.Table:
        parts = [_unpacked_bins(d) for d in table["data"].to_pylist()]
        key, n = _added([k for k, _ in parts], [n for _, n in parts])
        place = (key[n >= least] >> np.uint64(fold)) & np.uint64(places // buckets - 1)
        part = np.zeros(places // buckets, bool)
        part[place.astype(np.int64)] = True
        return pa.table({"bucket": table["bucket"].slice(0, 1), "part": pa.array([np.packbits(part).tobytes()], pa.binary())})

    found = parsed.mapInArrow(count, "bucket int, data binary").groupBy("bucket").applyInArrow(add, "bucket int, part binary")
    out = np.zeros((buckets, places // buckets // 8), np.uint8)
    for r in found.collect():  # bits / 8 bytes in all
        out[r["bucket"]] = np.frombuffer(r["part"], np.uint8)
    return out.ravel()


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(n, head) if len(key) else n


def _marked(array: np.ndarray, key: np.ndarray, total: int) -> np.ndarray:
    """Whether the bins of the keys are marked."""
    width = _bin_bits(total)
    place = key >> np.uint64(64 - width) >> np.uint64(max(0, width - ((len(array) * 8).bit_length() - 1)))
    return (array[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def phrase_counts(parsed: DataFrame, short, long_, total: int, longest: int) -> DataFrame:
    """lang, size, phrase, n: exact counts of all marked words and phrases of up to ``longest`` words.

    ``short`` and ``long_``: broadcast bit arrays of words and pairs, and of longer phrases.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _slices(batches, longest - 1):
            open_ = grams.open_pairs(short.value, total)
            for k in range(1, longest + 1):
                key, first, row, owned = grams.runs(k)
                for j in range(k - 1):
                    owned &= open_[first + j]
                if k != 2:
                    owned[owned] = _marked((short if k == 1 else long_).value, key[owned], total)
                key, first, row = key[owned], first[owned], row[owned]
                if not len(key):
                    continue
                begin, end = grams.starts[first], grams.ends[first + k - 1]
                check = C.mix(grams.hashes[first] + grams.hashes[first + k - 1] * np.uint64(5) + grams.seed[row])
                kept, (n,) = merged(key, check, [grams.n[row]])
                yield pa.RecordBatch.from_arrays([
                    grams.langs.take(pa.array(row[kept])), pa.array(np.full(len(kept), k, np.int32)),
                    _strings(grams.data, begin[kept], end[kept]), pa.array(n),
                ], ["lang", "size", "phrase", "n"])

    rows = parsed.mapInArrow(count, "lang string, size int, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _with_count(rows: DataFrame, cuts: DataFrame, limit: int, counts: DataFrame, part: str, out: str) -> DataFrame:
    """``rows`` with the count of (lang, ``part``).

    Parts that more than ``limit`` of the ``cuts`` ask for (common words) are at most HOT, as ``limit``
    is a HOT-th of the cuts or more.  They are looked up by broadcast, the rest by an ordinary join.
    """
    wanted = cuts.groupBy("lang", part).count().where(F.col("count") > limit).select("lang", part)
    named = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(out))
    hot = storage.save(named.join(wanted, ["lang", part], "left_semi"), storage.new_path(rows.sparkSession, "hot-parts"))
    few = F.broadcast(hot)  # at most HOT rows
    return rows.join(few, ["lang", part]).unionByName(
        rows.join(few.select("lang", part), ["lang", part], "left_anti").join(named, ["lang", part])
    )


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def scored(counts: DataFrame, least: int = LEAST, percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates that no longer candidate covers.

    The score is floor(SCORE_UNIT * a * a / (l * r)) of the cut where it is lowest, the first such
    cut if several are; all products are exact decimals.
    """
    spark = counts.sparkSession
    found = counts.where((F.col("size") >= 2) & (F.col("n") >= least)).withColumnRenamed("n", "a")
    inside = found.where("size > 2").withColumn("_w", F.split("phrase", " ")).select(
        "lang", "a", "_w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_k"), "size"
    ).select(
        "lang", "a", "_k", "_w", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_k") + 1)).alias("_at")
    ).select("lang", F.array_join(F.slice("_w", F.col("_at"), F.col("_k")), " ").alias("phrase"), "a")
    cover = inside.groupBy("lang", "phrase").agg(F.max("a").alias("top"))
    kept = found.join(cover, ["lang", "phrase"], "left").where(
        F.col("top").isNull() | (_exact("top") * 100 < _exact("a") * percent)
    ).drop("top")
    cuts = kept.withColumn("_w", F.split("phrase", " ")).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    ).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
    )
    cuts = storage.save(cuts, storage.new_path(spark, "phrase-cuts"))
    limit = max(cuts.count() // HOT, HOT)
    both = _with_count(_with_count(cuts, cuts, limit, counts, "head", "l"), cuts, limit, counts, "tail", "r")
    return both.withColumn("_a", _exact("a")).withColumn("_lr", _exact("l") * _exact("r")).withColumn(
        "score", F.expr(f"(cast({SCORE_UNIT} as decimal(19,0)) * _a * _a) div _lr")
    ).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score"
    )


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
    top: int = TOP, percent: int = INSIDE_PERCENT, every: int = TRIGGER_EVERY,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and the controls 10 to 13, and those
    into words at spaces and tabs.  A null text is empty, a null language is ``und``; repeated rows
    count as often as they occur.  Ties go by ``a``, then by the phrase in byte order.  An empty
    table, or one without a phrase of ``least`` occurrences, gives no rows.  Only the two named
    columns are read.
    """
    if longest < 2 or least < 1:
        raise ValueError("longest must be 2 or more, least 1 or more")
    spark = df.sparkSession
    parsed = storage.save(chunks(df, text_col, lang_col, longest, every), storage.new_path(spark, "chunks"))
    sizes = storage.save(
        parsed.groupBy("lang").agg(F.sum("words").alias("n")), storage.new_path(spark, "language-sizes")
    )
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    short = spark.sparkContext.broadcast(marks(parsed, total, least, longest, (1, 2)))
    sizes_above = tuple(range(3, longest + 1))
    long_ = spark.sparkContext.broadcast(marks(parsed, total, least, longest, sizes_above, short)) if sizes_above else None
    counts = storage.save(phrase_counts(parsed, short, long_, total, longest), storage.new_path(spark, "phrase-counts"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(counts, least, percent).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
