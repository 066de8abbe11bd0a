"""Embedding whitening: centred covariance by Spark, leading eigenpairs of the small matrix, projection.

Spark does all work that grows with the rows: the distinct vectors, their exact sums, the centred
covariance, the projection and its check.  Only the covariance itself, dimension x dimension
numbers, comes to the driver.  There it is made tridiagonal by Householder reflections, bisection on
Sturm counts finds the leading eigenvalues, and inverse iteration with reorthogonalisation inside
clusters finds their vectors, which are broadcast: at most ``components`` x dimension numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from phasegrid.sources import storage

SCALE = 64.0
SHIFT = 1_000_000
COMPONENTS = 16
# Entries beyond this size are clipped to it: 64-bit integers end not far above.
LARGEST = 2.0**61
# Eigenvalues closer than this share of the matrix norm are one cluster: their vectors are made
# orthogonal to each other explicitly.
CLUSTER = 1e-3
# An eigenvalue below this share of the largest is rounding noise, not a component.
RANK = 1e-12


class Whitening(NamedTuple):
    """A fitted projection: distinct vectors, sum by dimension, and components by falling variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite entries."""
    finite = F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vector: Column, scale: float = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of each entry, as long."""
    return F.transform(
        vector,
        lambda c: F.floor(F.greatest(F.least(F.lit(scale) * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))) + shift,
    )


def _matrix(column: pa.Array, dims: int, fill: int) -> np.ndarray:
    """The lists of an Arrow column as rows; entries that a shorter list lacks are ``fill``."""
    lists = column.cast(pa.large_list(pa.int64()))
    sizes = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.flatten())
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.full((len(sizes), dims), fill, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out[row, np.arange(len(values)) - np.repeat(begin, sizes)] = values
    return out


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers: high and low halves are added apart, so nothing overflows."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(s) for h, s in zip(high, low)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off in integers, so no digit is lost."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n * x - sums)**2; None where it passes 64 bits."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    y = x - whole
    far = (int(np.abs(y).max(initial=0)) + 1) * n
    if far * far * max(x.shape[1], 1) < 1 << 63:
        gap = y * n - rest
        return (gap * gap).sum(axis=1).tolist()
    gaps = y.astype(object) * n - rest.astype(object)
    return [d if d < 1 << 63 else None for d in (int(s) for s in (gaps * gaps).sum(axis=1))]


def _totals(fit: DataFrame, dims: int, fill: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims, fill)
            n, sums = n + len(x), [a + b for a, b in zip(sums, exact_sums(x))]
        yield pa.RecordBatch.from_pandas(pd.DataFrame({
            "dim": range(-1, dims), "total": [Decimal(v) for v in (n, *sums)],
        }), schema=pa.schema([("dim", pa.int32()), ("total", pa.decimal128(38, 0))]))

    by_dim = fit.mapInArrow(add, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    found = {r["dim"]: int(r["total"]) for r in by_dim.collect()}  # one row a dimension
    return found.get(-1, 0), [found.get(d, 0) for d in range(dims)]


def _products(fit: DataFrame, rows_of, dims: int) -> np.ndarray:
    """Sum over all rows of the outer product of ``rows_of(x)``: added up in each task, then by Spark."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            z = rows_of(batch)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "line"]
        )

    lines = fit.mapInArrow(multiply, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "v"))
    out = np.zeros((dims, dims))
    for r in lines.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dims x dims numbers
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors that take a symmetric matrix there."""
    a = np.array(a, np.float64)
    n, mirrors = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        size = np.linalg.norm(x)
        if np.linalg.norm(x[1:]) == 0:  # this column already has the form
            mirrors.append(np.zeros(0))
            continue
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        mirrors.append(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def _reflected(mirrors: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """A vector of the tridiagonal matrix carried back to the original one."""
    y = y.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        if len(v):
            part = y[k + 1 :]
            part -= 2 * (v @ part) * v
    return y


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0.0)))
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i, d in enumerate(diag):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection of all their intervals at once."""
    radius = np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])
    low, high = float((diag - radius).min()), float((diag + radius).max())
    margin = 2 * np.finfo(float).eps * max(abs(low), abs(high)) + np.finfo(float).tiny
    lows, highs = np.full(k, low - margin), np.full(k, high + margin)
    below = len(diag) - 1 - np.arange(k)  # how many eigenvalues are smaller than the one sought
    while True:
        middle = (lows + highs) / 2
        if ((middle <= lows) | (middle >= highs)).all():
            return highs
        more = sturm_counts(diag, off, middle) > below
        highs = np.where(more, middle, highs)
        lows = np.where(more, lows, middle)


def _solve(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = b by elimination with row exchanges; a zero pivot becomes ``least``."""
    n = len(diag)
    d, u1, u2, x = diag - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        sub = off[i]
        if abs(sub) > abs(d[i]):  # exchange rows i and i + 1
            f = d[i] / sub
            d[i], d[i + 1], u1[i], u2[i] = sub, u1[i] - f * d[i + 1], d[i + 1], u1[i + 1]
            u1[i + 1] = -f * u2[i]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            if abs(d[i]) < least:
                d[i] = least
            f = sub / d[i]
            d[i + 1] -= f * u1[i]
            x[i + 1] -= f * x[i]
    if abs(d[n - 1]) < least:
        d[n - 1] = least
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= u1[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= u2[i] * x[i + 2]
        x[i] /= d[i]
        if abs(x[i]) > 1e150:  # only the direction matters
            x /= abs(x[i])
    return x


def eigenvectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of falling eigenvalues by inverse iteration, orthogonal inside every cluster."""
    n = len(diag)
    norm = max(float(np.abs(diag).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    least = np.finfo(float).eps * norm
    rng = np.random.Generator(np.random.PCG64(12))
    out = np.zeros((len(values), n))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        y = rng.standard_normal(n)
        for _ in range(8):
            y = _solve(diag, off, value, y, least)
            y /= np.abs(y).max()
            for _ in range(2):  # the second time takes what rounding left
                y -= out[first:k].T @ (out[first:k] @ y)
            y /= np.linalg.norm(y)
        out[k] = y
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    size = float(np.abs(matrix).max(initial=0))
    if size == 0 or k <= 0:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diag, off, mirrors = tridiagonal(matrix / size)
    values = leading_eigenvalues(diag, off, min(k, len(matrix)))
    values = values[values > RANK * max(values[0], 0)] if values[0] > 0 else values[:0]
    vectors = eigenvectors(diag, off, values)
    return values * size, np.array([_reflected(mirrors, y) for y in vectors]).reshape(len(values), len(matrix))


def fit(distinct: DataFrame, vector_col: str, components: int = COMPONENTS, fill: int = SHIFT) -> Whitening:
    """Fit the projection on a table of distinct integer vectors; divisor of all moments is their number."""
    dims = distinct.agg(F.max(F.size(vector_col))).first()[0] or 0
    lists = distinct.select(vector_col)
    n, sums = _totals(lists, dims, fill) if dims else (0, [])
    if not n:
        return Whitening(0, sums, np.zeros((0, dims)), np.zeros(0), 0.0)
    cov = _products(lists, lambda batch: centred(_matrix(batch.column(0), dims, fill), n, sums), dims) / n
    values, vectors = leading(cov, components)
    return Whitening(n, sums, vectors, values, float(np.trace(cov)))


def identity_error(distinct: DataFrame, vector_col: str, w: Whitening, fill: int = SHIFT) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    k = len(w.values)
    if not k:
        return 0.0
    dims = len(w.sums)

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        z = _whitened(_matrix(batch.column(0), dims, fill), w)
        return np.column_stack([z, np.ones(len(z))])  # the last line gives the sums

    second = _products(distinct.select(vector_col), rows_of, k + 1) / w.n
    mean = second[k, :k]
    return float(np.abs(second[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _whitened(x: np.ndarray, w: Whitening) -> np.ndarray:
    return centred(x, w.n, w.sums) @ (w.vectors / np.sqrt(w.values)[:, None]).T


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
    scale: float = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row
    of ``df`` and component.

    A row whose vector is null or holds null or non-finite entries is left out.  Repeated rows and
    ids stay, but equal vectors count once in the fit.  Entries that a vector lacks against the
    longest one count as 0; entries beyond 2**61 after scaling are clipped.  A component of no
    variance (fewer distinct vectors than components, constant entries) is left out, so an empty
    table, or one distinct vector, gives no rows.  ``deviation`` is null where it passes 64 bits.
    Only the two named columns are read.
    """
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale, shift).alias("x")
    )
    distinct = storage.save(rows.select("x").distinct(), storage.new_path(spark, "distinct-vectors"))
    w = fit(distinct, "x", components, shift)
    error = identity_error(distinct, "x", w, shift)
    shared = spark.sparkContext.broadcast(w)  # bounded by the dimension
    k = len(w.values)
    schema = T.StructType([
        rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            if not k or not len(batch):
                continue
            x = _matrix(batch.column(1), len(w.sums), shift)
            rows = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            far = pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, w.n)), far, pa.array(_whitened(x, w).ravel()),
                pa.array(np.tile(w.values / w.trace, rows)), pa.array(np.full(rows * k, error)),
            ], schema.names)

    return rows.mapInArrow(project, schema)
