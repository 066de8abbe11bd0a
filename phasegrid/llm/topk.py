"""Exact top-k search by inner product without random access.

Every block of candidate rows holds one list a dimension, sorted by value.  The queries of a chunk read
the lists of all dimensions in step, from both ends: a query takes each list from the end where its
products are largest.  For every row it has the sum read so far: with the values at the reading
front this bounds the row's score from above, with the values at the far end from below.  A row
whose upper bound lies below the k-th best lower bound cannot qualify; a query stops when few
others are left, and only their entries are taken from the rest of the lists.  The k-th best score
of blocks that a task has done carries over to the next.

Queries go to every block, packed; no pair of a query and a row is ever a row of a table, and a
block gives at most k rows for each query.  Scores are exact integers.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phasegrid.llm.whitening import _matrix, quantised, usable
from phasegrid.sources import storage

K = 5
SCALE = 256.0
BLOCK_ROWS = 2048
QUERY_ROWS = 256
# Query chunks whose k-th best scores a task remembers.
BARS = 64
# A null id sorts after every other.
NO_ID = np.iinfo(np.int64).max
LIMITS = np.iinfo(np.int64)
# Shares of the lists at which bounds are looked at; queries that are not done then read to the end.
DEPTHS = (0.625, 1.0)


class Lists:
    """The sorted lists of one block: row numbers and values of each dimension, both falling."""

    def __init__(self, order: np.ndarray, values: np.ndarray):
        self.order, self.values = order.astype(np.intp), values
        self.dims, self.rows = order.shape
        self.size = int(np.abs(values).max(initial=0))

    @classmethod
    def of(cls, x: np.ndarray) -> Lists:
        order = np.argsort(-x, axis=0, kind="stable").T
        return cls(order, np.take_along_axis(x.T, order, 1))

    def read(self, known: np.ndarray, unseen: np.ndarray, lo: int, hi: int) -> None:
        """Put places lo to hi of each list, from the top and from the bottom, into ``known`` (two rows
        a dimension: read from the top, read from the bottom) and take them from ``unseen``."""
        ends = (slice(lo, hi), slice(self.rows - hi, self.rows - lo))
        for half, part in enumerate(ends):
            at = slice(half * self.dims, (half + 1) * self.dims)
            np.put_along_axis(known[at], self.order[:, part], self.values[:, part].astype(known.dtype), 1)
            np.put_along_axis(unseen[at], self.order[:, part], 0, 1)

    def vectors(self) -> np.ndarray:
        """The rows themselves, one a column, read from the whole lists."""
        x = np.zeros((self.dims, self.rows), np.int64)
        np.put_along_axis(x, self.order, self.values, 1)
        return x


def best(
    lists: Lists, q: np.ndarray, k: int, alive: np.ndarray, bars: np.ndarray
) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each query (row of ``q``): rows of the block that may be among the k best of all, their exact
    scores, and the share of the lists it read.  ``alive`` (query by row) marks the rows that count;
    scores below a query's bar do not."""
    dims, n, m = lists.dims, lists.rows, len(q)
    both = min(dims, q.shape[1])
    weight = np.zeros((m, dims), np.int64)
    weight[:, :both] = q[:, :both]
    most = int(np.abs(weight).max(initial=0)) * lists.size * max(dims, 1)
    if most >= 1 << 53:  # beyond exact doubles
        totals = weight.astype(object) @ lists.vectors().astype(object)
        clip = lambda row: np.array([min(max(int(s), LIMITS.min), LIMITS.max) for s in row], np.int64)
        rows = [np.flatnonzero(a) for a in alive]
        return rows, [clip(t[r]) for t, r in zip(totals, rows)], np.ones(m)
    kind = np.float32 if most < 1 << 24 else np.float64  # sums of integers are exact in either
    sign = np.concatenate([np.maximum(weight, 0), np.minimum(weight, 0)], 1).astype(kind)
    known, unseen = np.zeros((2 * dims, n), kind), np.ones((2 * dims, n), kind)
    far = np.concatenate([lists.values[:, -1], lists.values[:, 0]]).astype(kind)
    bars, open_, share = bars.astype(np.float64), alive.copy(), np.ones(m)
    final: dict[int, np.ndarray] = {}
    active, depth = np.arange(m), 0
    for part in DEPTHS:
        ahead = min(n, max(depth + 1, int(n * part)))
        lists.read(known, unseen, depth, ahead)
        depth = ahead
        mine = sign[active]
        upper = lower = mine @ known
        if depth < n:
            front = np.concatenate([lists.values[:, depth - 1], lists.values[:, n - depth]]).astype(kind)
            upper, lower = upper + (mine * front) @ unseen, lower + (mine * far) @ unseen
        if n >= k:
            low = np.where(alive[active], lower, -np.inf)
            bars[active] = np.maximum(bars[active], np.partition(low, n - k, axis=1)[:, n - k])
        open_[active] &= upper >= bars[active][:, None]
        done = open_[active].sum(axis=1) <= 2 * k
        share[active] = depth / n
        if depth == n:
            final = {int(i): upper[at] for at, i in enumerate(active)}
            break
        active = active[~done]
        if not len(active):
            break
    rows = [np.flatnonzero(o) for o in open_]
    if len(final) < m:  # resolve: the entries of the few left from the rest of the lists
        whole = lists.vectors()
        scores = [final[i][r].astype(np.int64) if i in final else weight[i] @ whole[:, r] for i, r in enumerate(rows)]
    else:
        scores = [final[i][r].astype(np.int64) for i, r in enumerate(rows)]
    keep = [s >= b for s, b in zip(scores, bars)]
    return [r[x] for r, x in zip(rows, keep)], [s[x] for s, x in zip(scores, keep)], share


def _packed(df: DataFrame, rows: int, pack, schema: str) -> DataFrame:
    """``pack(ids, vectors)`` of every run of up to ``rows`` rows of (id, x) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, len(batch), rows):
                held.append(batch.slice(lo, rows))
                while sum(map(len, held)) >= rows:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield pack(whole.slice(0, rows))
                    held = [whole.slice(rows)]
        if sum(map(len, held)):
            yield pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return df.mapInArrow(run, schema)


def _vectors(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays([column])  # a slice keeps its parent's offsets
    return _matrix(column, max((len(v) for v in column), default=0), 0)


def _ids(column: pa.Array) -> pa.Array:
    return pa.array([column.to_pylist()], pa.list_(pa.int64()))


def _pack_lists(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = Lists.of(_vectors(batch.column(1)))
    return pa.RecordBatch.from_arrays([
        _ids(batch.column(0)), pa.array([lists.dims], pa.int32()),
        pa.array([lists.order.astype("<u2").tobytes()]), pa.array([lists.values.astype("<i8").tobytes()]),
    ], ["ids", "dims", "order", "values"])


def _pack_queries(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = _vectors(batch.column(1))
    return pa.RecordBatch.from_arrays(
        [_ids(batch.column(0)), pa.array([x.shape[1]], pa.int32()), pa.array([x.astype("<i8").tobytes()])],
        ["query_ids", "query_dims", "query_rows"],
    )


def _compare(k: int):
    """Rows (query block beside candidate block) to at most k rows for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: OrderedDict[str, np.ndarray] = OrderedDict()
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
                real = np.array([i is not None for i in row["ids"]])
                lists = Lists(
                    np.frombuffer(row["order"], "<u2").reshape(row["dims"], n),
                    np.frombuffer(row["values"], "<i8").reshape(row["dims"], n),
                )
                own = np.array(row["query_ids"], np.int64)
                q = np.frombuffer(row["query_rows"], "<i8").reshape(len(own), row["query_dims"])
                known = bars.pop(row["chunk"], None)
                if known is None:
                    known = np.full((len(own), k), -np.inf)
                alive = (ids[None, :] != own[:, None]) | ~real[None, :]
                out = []
                for i, (found, scores) in enumerate(zip(*best(lists, q, k, alive, known[:, 0])[:2])):
                    first = np.lexsort((ids[found], -scores))[:k]
                    found, scores = found[first], scores[first]
                    known[i] = np.sort(np.concatenate([known[i], scores.astype(np.float64)]))[-k:]
                    out.append((np.full(len(found), i), found, scores))
                bars[row["chunk"]] = known
                while len(bars) > BARS:
                    bars.popitem(last=False)
                at, found, scores = (np.concatenate(x) for x in zip(*out))
                found, at = found.astype(np.intp), at.astype(np.intp)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["chunk"]] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at]),
                    pa.array(ids[found], mask=~real[found]), pa.array(scores, pa.int64()),
                ], ["chunk", "place", "query_id", "vec_id", "score"])

    return run


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the highest inner product for each query.

    Components become floor(scale * x).  Equal scores go by the smaller id, a null id last.  Rows of
    the query's own id are not its candidates; a repeated query row has its own k results, and a
    query without an id is left out.  Vectors that are null or hold null or non-finite entries take
    no part.  Entries that a vector lacks count as 0.  Scores beyond 64 bits are clipped.  A query
    without candidates gives no rows.  Only the two named columns are read.
    """
    spark = candidates.sparkSession
    block_rows = min(block_rows, 1 << 16)

    def integers(df: DataFrame) -> DataFrame:
        good: Column = usable(F.col(vector_col))
        return df.where(good).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale, 0).alias("x"))

    blocks = _packed(
        integers(candidates), block_rows, _pack_lists, "ids array<bigint>, dims int, order binary, values binary"
    ).withColumn("block", F.expr("uuid()"))
    blocks = storage.save(blocks, storage.new_path(spark, "list-blocks"))
    bands = max(blocks.count(), 1)
    asked = storage.save(integers(queries).where("id IS NOT NULL"), storage.new_path(spark, "query-rows"))
    chunks = _packed(
        asked.repartition(-(-max(asked.count(), 1) // query_rows)), query_rows, _pack_queries,
        "query_ids array<bigint>, query_dims int, query_rows binary",
    ).withColumn("chunk", F.expr("uuid()"))
    chunks = storage.save(chunks, storage.new_path(spark, "query-blocks"))
    # Every chunk meets every band of blocks; more than one block may fall into a band, or none.
    mine = chunks.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    lists = blocks.withColumn("band", F.pmod(F.xxhash64("block"), F.lit(bands)).cast("int"))
    pairs = mine.hint("merge").join(lists, "band").drop("band")
    found = pairs.mapInArrow(_compare(k), "chunk string, place int, query_id long, vec_id long, score long")
    order = Window.partitionBy("chunk", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
