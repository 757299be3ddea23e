"""Whitening of integer vectors, with the covariance by polarisation.

For every dimension i and every pair i < j the squares of the centred values y_i and y_i + y_j are summed over all rows, in integers and without any
rounding. The cross-covariance is the difference of their variances: 2 cov(i, j) = var(i + j) - var(i) - var(j). The d x d matrix of quotients goes to
``eigh`` in the driver; its size depends on the number of dimensions alone.

Values are centred before they are squared, at the whole number nearest to their dimension's mean; what the mean has beyond that, a fraction of n, is taken
off the exact sums. Sums leave a task as digits of base 2^30, which Spark adds up as longs, so no size of table or entry makes one overflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb

DIGIT = 30                 # bits of a digit of an exact sum
LARGEST = 1 << 62          # entries beyond are set to it, so that an integer always fits 63 bits
MOST_DIMENSIONS = 4096     # the matrix of the driver: 128 MB
LONG = 1 << 63
CHUNK_CELLS = 1 << 20      # entries squared at once


@dataclass
class Model:
    n: int
    centre: list[int]          # whole number nearest to the mean of each dimension
    rest: list[int]            # n * (mean - centre)
    axes: np.ndarray           # unit eigenvectors, a column per component
    values: np.ndarray         # their eigenvalues, falling
    trace: float


def _integers(vec: pa.Array, d: int, unit: float, shift: int) -> np.ndarray:
    """floor(unit * entry) + shift of every entry; a shorter vector counts as filled up with zeros."""
    lengths = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vec), d))
    out[np.arange(d)[None, :] < lengths[:, None]] = vec.flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(out * unit)
    return np.clip(whole, -(LARGEST - 2 * abs(shift)), LARGEST - 2 * abs(shift)).astype(np.int64) + shift


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre; as Python integers where 64 bits might not do."""
    c = np.array(centre, dtype=object)
    if len(x) and (np.abs(x).max() >= 1 << 61 or max(map(abs, centre), default=0) >= 1 << 61):
        return x.astype(object) - c
    return x - c.astype(np.int64)


def _square_sums(y: np.ndarray) -> list[list[int]]:
    """For each dimension i: the sum of y_i squared, then those of (y_i + y_j) squared for every j > i."""
    if not len(y):
        return [[0] * (y.shape[1] - i) for i in range(y.shape[1])]
    top = int(np.abs(y).max())
    if y.dtype != object and 4 * top * top * len(y) >= LONG:
        y = y.astype(object)
    out = []
    for i in range(y.shape[1]):
        pair = y[:, i:] + y[:, i:i + 1]
        pair[:, 0] = y[:, i]
        out.append([int(v) for v in (np.einsum("ij,ij->j", pair, pair) if y.dtype != object else (pair * pair).sum(axis=0))])
    return out


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number; the digits of a negative one are negative."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        yield place, sign * (rest & ((1 << DIGIT) - 1))
        rest, place = rest >> DIGIT, place + 1


def _laid(sums: list[list[int]]) -> pa.RecordBatch:
    """Rows (i, j, place, digit) of the sums of a task."""
    rows = [(i, j, place, digit) for i, own in enumerate(sums) for j, value in enumerate(own) for place, digit in _digits(value)]
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["i", "j", "place", "digit"])


def _exact(rows: DataFrame, sums) -> dict[tuple[int, int], int]:
    """{(i, j): sum over all rows}; ``sums`` gives the lists of one batch. The driver gets one row per sum and digit, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = sums(batch)
            total = own if total is None else [[a + b for a, b in zip(x, y)] for x, y in zip(total, own)]
        if total is not None:
            yield _laid(total)

    found: dict[tuple[int, int], int] = {}
    parts = rows.mapInArrow(run, "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum("digit").alias("digit"))
    for r in parts.toLocalIterator():
        found[r.i, r.j] = found.get((r.i, r.j), 0) + (r.digit << (DIGIT * r.place))
    return found


def fit(vectors: DataFrame, vec: str = "vec", unit: float = 64.0, shift: int = 1_000_000) -> Model:
    """Means, principal axes and their variances of x = floor(unit * entry) + shift over all rows; every row must be ``topk.usable``.

    Vectors of unequal length are filled up with zeros; repeated rows count each. Without rows, or in a table of equal rows, all variances are 0.
    """
    wb.bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec).cast("array<double>").alias("vec"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, d = size.n, size.d or 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    if not n or not d:
        return Model(n, [], [], np.zeros((d, 0)), np.zeros(0), 0.0)

    def plain_sums(batch: pa.RecordBatch) -> list[list[int]]:
        x = _integers(batch.column("vec"), d, unit, shift)
        high, low = x >> DIGIT, x & ((1 << DIGIT) - 1)
        return [[(int(a) << DIGIT) + int(b)] for a, b in zip(high.sum(axis=0), low.sum(axis=0))]

    total = _exact(rows, plain_sums)
    sums = [total.get((i, 0), 0) for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]

    def square_sums(batch: pa.RecordBatch) -> list[list[int]]:
        y = _centred(_integers(batch.column("vec"), d, unit, shift), centre)
        step = max(1, CHUNK_CELLS // d)
        out = _square_sums(y[:step])
        for a in range(step, len(y), step):
            out = [[p + q for p, q in zip(u, v)] for u, v in zip(out, _square_sums(y[a:a + step]))]
        return out

    squares = _exact(rows, square_sums)

    def variance(i: int, j: int) -> int:
        """n^2 times the variance of y_i (j = i) or of y_i + y_j."""
        mean = rest[i] if i == j else rest[i] + rest[j]
        return n * squares.get((i, j - i), 0) - mean * mean

    own = [variance(i, i) for i in range(d)]
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = own[i] / (n * n)          # quotients of whole numbers, rounded once
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (variance(i, j) - own[i] - own[j]) / (2 * n * n)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    turned = axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0
    return Model(n, centre, rest, np.where(turned, -axes, axes), values, sum(own) / (n * n))


def _parts(batch: pa.RecordBatch, model: Model, components: int, unit: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """x - centre, and the projections of x - mean on the components over the roots of their variances; NaN where there is no variance."""
    y = _centred(_integers(batch.column("vec"), len(model.centre), unit, shift), model.centre)
    off = y.astype(np.float64) - np.array([r / model.n for r in model.rest])
    e = model.values[:components]
    real = e > _smallest(model)
    out = np.full((len(y), len(e)), np.nan)
    out[:, real] = off @ model.axes[:, :components][:, real] / np.sqrt(e[real])
    return y, out


def _smallest(model: Model) -> float:
    """Variances up to this are rounding of 0."""
    return max(float(model.values[0]), 0.0) * len(model.values) * np.finfo(float).eps if len(model.values) else 0.0


def identity_error(vectors: DataFrame, model: Model, components: int = 32, vec: str = "vec", unit: float = 64.0, shift: int = 1_000_000) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity, measured over all rows; 0 without components.

    Components without variance have no whitened values and are left out.
    """
    k = int((model.values[:components] > _smallest(model)).sum())
    if not k:
        return 0.0
    rows = vectors.select(F.col(vec).cast("array<double>").alias("vec"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _parts(batch, model, k, unit, shift)[1]
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((k + 1, k))
    for r in rows.mapInArrow(gather, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k * (k + 1) rows
        total[r.i, r.j] = r.s
    mean = total[k] / model.n                # whitened values are centred already; this is what rounding left
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Model, components: int = 32, key: str = "vec_id", vec: str = "vec", unit: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained): a row per row of ``vectors`` and component, numbered from 1 by falling variance.

    ``deviation`` is the sum over the dimensions of (n x - S)^2, S the dimension's sum, exact; null where it does not fit 63 bits. ``whitened`` is null for a
    component without variance, ``explained`` then 0. A null key stays, repeated rows give repeated rows, no rows give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    wb.bounded_batches(spark)
    components = min(components, len(model.values))
    schema = T.StructType([
        T.StructField("id", vectors.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)   # d * d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        e = m.values[:components]
        share = np.where(e > _smallest(m), e, 0.0) / (m.trace if m.trace > 0 else 1.0)
        step = max(1, CHUNK_CELLS // max(1, components, len(m.centre)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                y, w = _parts(batch, m, components, unit, shift)
                rows = np.repeat(np.arange(len(y)), components)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(rows), m.n, np.int64)), pa.array(_deviations(y, m), pa.int64()).take(pa.array(rows)),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, len(y)))], schema.names)

    if not components:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    out = vectors.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", key)


def _deviations(y: np.ndarray, m: Model) -> list[int | None]:
    """Sum over the dimensions of (n * y - rest)^2 of each row."""
    top = int(np.abs(y).max()) if y.size else 0
    if (m.n * (top + 1)) ** 2 * max(1, y.shape[1]) < LONG:
        z = y.astype(np.int64) * m.n - np.array(m.rest, np.int64)
        return np.einsum("ij,ij->i", z, z).tolist()
    z = y.astype(object) * m.n - np.array(m.rest, dtype=object)
    found = (z * z).sum(axis=1)
    return [int(x) if x < LONG else None for x in found]
