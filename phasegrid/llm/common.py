"""Helpers of the corpus operators: columns, and numpy views of Arrow text columns.

Every operator reads the columns named in its arguments and ignores all others, so extra columns
of any name never clash with what it adds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The word separators of all contracts: space and the controls 9 to 13.
SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_HASH = _rng.integers(1, 2**64, 256, dtype=np.uint64)
FOLDED_HASH = BYTE_HASH[FOLD]
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 4 << 20
# Bytes of spans hashed at once.
SPAN_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; after its last batch the worker gives Arrow's freed memory back.

    Spark keeps workers for later tasks, in turns, and Arrow would keep some 100 MB in each of them.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes: (first, end, bytes, offsets).

    A null is an empty text.  One text longer than the limit is a slice of its own.
    """
    col = column.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return

    def parts(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, ends, body = rows.buffers()
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        return data, np.frombuffer(ends, np.int64)[rows.offset : rows.offset + len(rows) + 1]

    _, sizes = parts(col)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + limit, "right")) - 1)
        rows = col.slice(lo, hi - lo)
        data, off = parts(rows.fill_null(b"") if rows.null_count else rows)  # copies a slice, not the column
        yield lo, hi, data[off[0] : off[-1]], off - off[0]
        lo = hi


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many true entries each row of the offsets has."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and word offsets by row; a row's end also ends a word."""
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    rows = off[:-1][off[:-1] < len(data)]
    first[rows] = solid[rows]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    rows = off[1:][off[1:] > 0] - 1
    last[rows] = solid[rows]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order, not overlapping, none empty)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    power = powers(int(size.max()))
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(len(size), np.uint64)
    lo = 0
    while lo < len(size):  # a byte takes some 40 bytes on the way, so not all spans at once
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SPAN_BYTES, "right")) - 1)
        n, begin = size[lo:hi], total[lo:hi] - total[lo]
        at = np.arange(int(total[hi] - total[lo])) - np.repeat(begin, n)
        out[lo:hi] = np.add.reduceat(table[data[at + np.repeat(starts[lo:hi], n)]] * power[at], begin)
        lo = hi
    return mix(out + size.astype(np.uint64) * BASE)


def run_hashes(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` consecutive words inside each row: (hash, first word, row)."""
    n = np.diff(off)
    runs = np.maximum(n - k + 1, 0)
    row = np.repeat(np.arange(len(n)), runs)
    begin = np.concatenate([[0], np.cumsum(runs)[:-1]])
    first = np.arange(int(runs.sum())) - np.repeat(begin, runs) + np.repeat(off[:-1], runs)
    total = np.zeros(len(first), np.uint64)
    for j in range(k):
        total = mix(total + words[first + j] * np.uint64(2 * j + 1))
    return total, first, row
