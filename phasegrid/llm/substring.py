"""Removal of repeated sentence spans over the whole corpus.

Every run of RUN consecutive sentences is hashed where it stands; equal hashes meet over all
documents; each sentence covered by a run that is not the first of its kind is removed.

With ``whole`` a run of fewer than LEAST words grows by the sentences that follow, and long sentences
are cut where their words say, not at every LONGEST words from their begin.  The pieces then depend
on at most LONGEST words around a place, so every repeated stretch of 50 words or more loses all but
its outermost pieces (LONGEST words each at most), whatever its sentences and wherever it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phasegrid.llm import common as C
from phasegrid.sources import storage

# Sentences of a run; words after which a long sentence is cut; words a run must have.
RUN, LONGEST, LEAST = 3, 12, 12
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def _content_cuts(words: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words that follow the smallest hash (the last of equals) of some LONGEST consecutive words of
    their sentence: no piece is longer, and equal surroundings are cut alike."""
    cuts = np.zeros(len(words) + 1, bool)
    if len(words) >= LONGEST:
        spread = C.mix(words)
        windows = np.lib.stride_tricks.sliding_window_view(spread, LONGEST)
        inside = np.flatnonzero((place + LONGEST <= size)[: len(windows)])
        if len(inside):
            least = LONGEST - 1 - np.argmin(windows[inside, ::-1], axis=1)
            cuts[inside + least + 1] = True
    return cuts[:-1]


def sentences(data: np.ndarray, off: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts of a slice, first word of each sentence, and word and sentence offsets by text.

    A sentence ends after a word with a full stop, exclamation or question mark, at a line feed and
    at the text's end; a longer one is cut every LONGEST words, or by its content if ``whole``.
    """
    starts, ends, words = C.word_spans(data, off)
    n = len(starts)
    begins = np.zeros(n, bool)
    if n:
        feeds = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
        begins[1:] = _END[data[ends[:-1] - 1]] | (feeds[starts[1:]] > feeds[ends[:-1]])
        begins[words[:-1][words[:-1] < n]] = True
        first = np.flatnonzero(begins)
        size = np.diff(first, append=n)
        place = np.arange(n) - np.repeat(first, size)
        if whole:
            size = np.repeat(size, size)
            begins |= _content_cuts(C.span_hashes(data, starts, ends), place, size) & (size > LONGEST)
        else:
            begins |= place % LONGEST == 0
    first = np.flatnonzero(begins)
    return starts, first, words, np.searchsorted(first, words)


def run_ends(total: np.ndarray, at: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """First sentences of all runs with LEAST words or more, and the sentences after their last.

    total: words before each sentence and at the end; at: sentence offsets by text.
    """
    head = np.arange(len(total) - 1)
    end = head + RUN
    if whole:
        end = np.maximum(end, np.searchsorted(total, total[:-1] + LEAST))
    fits = end <= np.repeat(at[1:], np.diff(at))
    head, end = head[fits], end[fits]
    long_enough = total[end] - total[head] >= LEAST
    return head[long_enough], end[long_enough]


def run_table(data: np.ndarray, off: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, row and first sentence (counted in its text) of every run with LEAST words or more."""
    starts, ends, _ = C.word_spans(data, off)
    _, first, _, at = sentences(data, off, whole)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    size = np.diff(first, append=len(starts))
    place = np.arange(len(starts)) - np.repeat(first, size)
    words = C.mix(C.span_hashes(data, starts, ends) + place.astype(np.uint64) * C.BASE)
    one = C.mix(np.add.reduceat(words, first) + size.astype(np.uint64))
    head, end = run_ends(np.concatenate([[0], np.cumsum(size)]), at, whole)
    # A run's hash is a polynomial of its sentences' hashes, taken from running sums.
    up = C.powers(len(one) + 1)
    down = np.full(len(one) + 1, pow(int(C.BASE), -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * up[:-1], dtype=np.uint64)])
    found = C.mix((sums[end] - sums[head]) * down[head] + (end - head).astype(np.uint64))
    row = np.searchsorted(at, head, "right") - 1
    return found, row, head - at[row]


def runs(df: DataFrame, whole: bool = False) -> DataFrame:
    """hash, id, key, pos of all runs; df: id, key, text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in C.text_slices(batch.column(2)):
                found, row, pos = run_table(data, off, whole)
                where = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), batch.column(0).take(where), batch.column(1).take(where),
                     pa.array(pos.astype(np.int32))], ["hash", "id", "key", "pos"])

    return df.mapInArrow(hashed, "hash long, id long, key long, pos int")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with repeated sentences cut from the text, and ``removed``:
    array<struct<start, end>> of the cut spans of the original text in code points.

    The first of equal runs is that of the smallest id, then of the earliest place.  Equal (id,
    text) rows count as one document and are treated alike; a null id comes first; a null text
    stays null and an empty one empty.  A column named ``removed`` is replaced.  Without ``whole``,
    runs of fewer than LEAST words and long sentences of another begin are not compared.
    """
    spark = df.sparkSession
    df = df.select(*[c for c in df.columns if c != "removed"])
    name, cuts = C.fresh(df, "_key"), C.fresh(df, "_cut")
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    slim = df.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    found = storage.save(runs(slim, whole), storage.new_path(spark, "runs"))
    repeated = (
        found.groupBy("hash").agg(F.min(F.struct("id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n")
    )
    later = (
        found.join(repeated, "hash")
        .where((F.col("key") != F.col("first.key")) | (F.col("pos") != F.col("first.pos")))
        .groupBy(F.col("key").alias(name)).agg(F.sort_array(F.collect_set("pos")).alias(cuts))
    )
    joined = df.withColumn(name, key).join(later, name, "left").select(*df.columns, cuts)
    none = F.array().cast("array<struct<start:int,end:int>>")
    schema = df.withColumn("removed", none).schema
    at_text, width = df.columns.index(text_col), len(df.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            column = batch.column(at_text).cast(pa.binary())
            for text, pos in zip(column.to_pylist(), batch.column(width).to_pylist(), strict=True):
                if not pos:
                    texts.append(text)
                    spans.append([])
                    continue
                data = np.frombuffer(text, np.uint8)
                starts, first, _, at = sentences(data, np.array([0, len(data)]), whole)
                head, end = run_ends(np.append(first, len(starts)), at, whole)
                gone = np.zeros(len(first) + 1, bool)
                for p, e in zip(pos, end[np.searchsorted(head, pos)].tolist(), strict=True):
                    gone[p:e] = True
                edge = np.append(starts[first], len(data))
                turn = np.flatnonzero(np.diff(gone[:-1].astype(np.int8), prepend=0, append=0))
                pairs = [(int(edge[a]), int(edge[b])) for a, b in zip(turn[::2], turn[1::2], strict=True)]
                keep, last = [], 0
                for a, b in pairs:
                    keep.append(text[last:a])
                    last = b
                texts.append(b"".join([*keep, text[last:]]))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                spans.append([{"start": int(chars[a]), "end": int(chars[b])} for a, b in pairs])
            columns = list(batch.columns[:width])
            columns[at_text] = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], schema.names)

    return joined.mapInArrow(cut, schema)
