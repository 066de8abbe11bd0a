"""Language identification by unigram pieces, summed over all segmentations of each word.

The pieces are those of a fixed public vocabulary.  Each language has a probability for each piece,
learned by expectation-maximisation; a forward pass adds up the probability of every way to cut a
word into pieces, so no single segmentation has to be right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phasegrid.llm import common as C
from phasegrid.sources import storage

# Labelled rows that the piece probabilities are learned from, at most (those of smallest hash).
TRAIN_ROWS = 8192
ITERATIONS = 2
SMOOTHING = 0.1
# A piece vocabulary marks the begin of a word so; longer words are cut into parts of this length.
MARK, LONGEST = "▁", 48
# Probability of a character that no piece covers, relative to an even share.
UNKNOWN = 1e-3
UNDETERMINED = "und"
# All segmentations of a prefix have the same number of characters, so this factor for each character
# cancels; it keeps the sums of a part of 48 characters, covered or not, within doubles.
GAIN = 1e4
_B = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 20


def read_pieces(path: str) -> list[str]:
    """Normal pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)]


class Lattice:
    """Pieces by hash, for whole arrays of substrings at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        codes = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
        keys = np.zeros(len(pieces), np.uint64)
        for j in range(self.longest):
            has = np.array([len(c) > j for c in codes], bool)
            keys[has] = keys[has] * _B + np.array([c[j] for c in codes if len(c) > j], np.uint64)
        keys = C.mix(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.n = len(pieces)
        # A direct table of the first key of each slot; the rest is searched.
        self.slot = np.full(_SLOTS, -1, np.int32)
        place = (self.keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        self.slot[place[::-1]] = np.arange(len(place))[::-1]
        self.crowded = np.zeros(_SLOTS, bool)
        values, count = np.unique(place, return_counts=True)
        self.crowded[values[count > 1]] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each substring hash; n where there is none."""
        if not self.n:
            return np.zeros(len(hashes), np.int64)
        keys = C.mix(hashes)
        place = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        at = self.slot[place]
        hit = (at >= 0) & (self.keys[at] == keys)
        out = np.where(hit, self.ids[at], self.n)
        again = np.flatnonzero(~hit & self.crowded[place])
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, keys[again]), self.n - 1)
            out[again] = np.where(self.keys[at] == keys[again], self.ids[at], self.n)
        return out

    def cuts(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece of every substring (i, j) of equally long words (rows of code points)."""
        n, length = codes.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _B + codes[:, j]
        power = C.powers(self.longest + 1)
        return {
            (j - k, j): self.find(prefix[j] - prefix[j - k] * power[k])
            for j in range(1, length + 1)
            for k in range(1, min(self.longest, j) + 1)
        }

    def forward(self, codes: np.ndarray, prob: np.ndarray) -> tuple[list[np.ndarray], dict]:
        """Probability (words x languages) of each prefix, summed over all segmentations.

        ``prob`` has a row for each piece, one of zeros and one for an uncovered character.  Sums
        carry a factor of GAIN for each character.
        """
        n, length = codes.shape
        cut = self.cuts(codes)
        alpha = [np.ones((n, prob.shape[1]))]
        for j in range(1, length + 1):
            total = np.zeros((n, prob.shape[1]))
            for k in range(1, min(self.longest, j) + 1):
                piece = cut[j - k, j]
                if k == 1:
                    piece = cut[j - 1, j] = np.where(piece == self.n, self.n + 1, piece)
                    total += alpha[j - 1] * prob[piece] * GAIN
                elif len(known := np.flatnonzero(piece < self.n)):
                    total[known] += alpha[j - k][known] * prob[piece[known]] * GAIN**k
            alpha.append(total)
        return alpha, cut

    def expected(self, codes: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses (pieces x languages) given how often each word occurs in each language."""
        alpha, cut = self.forward(codes, prob)
        n, length = codes.shape
        beta = [np.zeros_like(alpha[0]) for _ in range(length)] + [np.ones_like(alpha[0])]
        out = np.zeros_like(prob)
        scale = np.divide(weight, alpha[length], out=np.zeros_like(weight), where=(weight > 0) & (alpha[length] > 0))
        for j in range(length, 0, -1):
            for k in range(1, min(self.longest, j) + 1):
                piece = cut[j - k, j]
                known = np.flatnonzero(piece != self.n)
                if len(known):
                    gain = prob[piece[known]] * GAIN**k * beta[j][known]
                    beta[j - k][known] += gain
                    np.add.at(out, piece[known], gain * alpha[j - k][known] * scale[known])
        return out


def _words_by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and code points of the words of each length."""
    length = np.array([len(w) for w in words])
    for n in np.unique(length[length > 0]):
        which = np.flatnonzero(length == n)
        for part in np.array_split(which, max(1, len(which) // 20_000)):
            joined = "".join([words[i] for i in part.tolist()])
            yield part, np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)


def _parts(word: str) -> list[str]:
    marked = MARK + word
    return [marked[i : i + LONGEST] for i in range(0, len(marked), LONGEST)]


def held_out(id_: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces + 2, languages) from at most ``rows`` labelled
    texts that are not held out; words are counted and their expectations added up by Spark."""
    spark = df.sparkSession
    usable = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"))
    ).withColumn("h", F.xxhash64("id", F.lit(5)))
    last = usable.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    none = np.zeros((len(pieces) + 2, 0))
    if last is None:
        return [], none
    chosen = usable.where(F.col("h") <= last)
    if chosen.select("h").count() > rows:  # repeated ids share a hash
        chosen = chosen.limit(rows).repartition(spark.sparkContext.defaultParallelism)
    counted = storage.save(
        chosen
        .select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
        .where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).cast("double").alias("n")),
        storage.new_path(spark, "lang-words"),
    )
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())  # at most `rows`
    if not langs:
        return [], none
    prob = np.full((len(pieces) + 2, len(langs)), 1.0 / (len(pieces) + 1))
    prob[-2], prob[-1] = 0.0, UNKNOWN / (len(pieces) + 1)
    number = {name: i for i, name in enumerate(langs)}
    for _ in range(ITERATIONS):
        shared = spark.sparkContext.broadcast((pieces, prob))  # the fixed vocabulary times languages

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(shared.value[0])
            total = np.zeros_like(shared.value[1])
            for batch in batches:
                words = [_parts(w) for w in batch["word"].to_pylist()]
                flat = [p for parts in words for p in parts]
                owner = np.repeat(np.arange(len(words)), [len(p) for p in words])
                weight = np.zeros((len(words), total.shape[1]))
                weight[np.arange(len(words)), [number[x] for x in batch["lang"].to_pylist()]] = batch["n"].to_numpy()
                for which, codes in _words_by_length(flat):
                    total += lattice.expected(codes, shared.value[1], weight[owner[which]])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        sums = counted.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        uses = np.zeros_like(prob)
        uses[sums["piece"], sums["lang"]] = sums["n"]
        uses = uses[:-2] + SMOOTHING
        prob = np.concatenate([uses / uses.sum(0), np.zeros((1, len(langs))), np.full((1, len(langs)), UNKNOWN / (len(pieces) + 1))])
    return langs, prob


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], pieces: list[str], text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of each row with ``lang_pred`` and ``score``.

    score: the probability of the predicted language given the text and equal priors.  Null, empty
    and letterless texts, and all texts when nothing was learned, are ``und`` with score 0; ties go
    to the language first in order.  Columns of these two names are replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = df.select(*kept, F.col(text_col).alias("_text"))
    schema = df.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = df.sparkSession.sparkContext.broadcast((model, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (langs, prob), vocabulary = shared.value
        lattice = Lattice(vocabulary)
        names = np.array([*langs, UNDETERMINED], object)
        for batch in batches:
            for lo, hi, data, off in C.text_slices(batch.column(len(kept)), 16 << 20):
                pred, score = _classify(lattice, prob, data, off)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns[: len(kept)], pa.array(names[pred], pa.string()), pa.array(score)],
                    schema.names)

    return source.mapInArrow(run, schema)


def _classify(lattice: Lattice, prob: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number (the number of languages for none) and score of each text of a slice."""
    n, k = len(off) - 1, prob.shape[1]
    starts, ends, words = C.word_spans(data, off)
    _, first, inverse = np.unique(C.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    distinct = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    alphabetic = np.array([any(map(str.isalpha, w)) for w in distinct], bool)
    parts = [_parts(w) for w in distinct]
    flat = [p for x in parts for p in x]
    owner = np.repeat(np.arange(len(distinct)), [len(x) for x in parts])
    logs = np.zeros((len(distinct), k))
    for which, codes in _words_by_length(flat):
        alpha, _ = lattice.forward(codes, prob)
        np.add.at(logs, owner[which], np.log(np.maximum(alpha[-1], 1e-300)))
    row = np.repeat(np.arange(n), np.diff(words))
    total = np.stack([np.bincount(row, logs[inverse, j], minlength=n) for j in range(k)], 1) if k else np.zeros((n, 0))
    lettered = np.bincount(row, alphabetic[inverse], minlength=n) > 0 if len(row) else np.zeros(n, bool)
    if not k:
        return np.zeros(n, int), np.zeros(n)
    best = total.argmax(1)
    score = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
    return np.where(lettered, best, k), np.where(lettered, score, 0.0)


def identify(df: DataFrame, piece_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             rows: int = TRAIN_ROWS) -> DataFrame:
    """id, held_out, lang_pred and score of each row; learned from ``df`` as ``learn`` says."""
    pieces = read_pieces(piece_path)
    model = learn(df, pieces, id_col, text_col, lang_col, rows)
    named = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_body"))
    return predict(named, model, pieces, "_body", [id_col, "held_out"])
