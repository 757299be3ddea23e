"""Exact top-k inner products of integer vectors, without scoring every pair.

Items are dealt into blocks by descending length: LEVELS length classes, each cut into blocks of about BLOCK items. A query starts with the k-th
best score it has among the HEAD longest items and visits only the classes whose longest item can still reach it (Cauchy-Schwarz on whole
lengths). Inside a block items go by descending length in strips. The axes of all vectors are rotated to their principal ones (the SVD of the
table, from its d x d moment matrix), so the first few coordinates carry most of a product: the partial sum over them plus the product of the
residual lengths bounds the score, and only pairs whose bound reaches the query's threshold are multiplied out, in integers.

Queries of a block are dealt over splits of about SPLIT, so the work of one task does not grow with the table; what grows is the number of
tasks. The driver holds the moment matrix, the rotation, HEAD items and LEVELS class sizes, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb
from listingscope.session import cut

BLOCK, SPLIT, STRIP, HEAD, LEVELS = 2048, 65536, 512, 1024, 32
MOST_DIMENSIONS = 4096
PAIRS = 1 << 16   # pairs multiplied out at once
SLACK = 0.5       # scores are integers, so rounding of bounds below half a unit loses nothing


def usable(vec: Column) -> Column:
    """Not null, without null and non-finite components."""
    real = vec.cast("array<double>")
    return vec.isNotNull() & ~F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def in_units(vec: Column, unit: float = 256.0) -> Column:
    """floor(unit * x) of every component, x as double."""
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(x * F.lit(unit)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of integers; a shorter vector counts as filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _moments(items: DataFrame, d: int) -> np.ndarray:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column("vec"), d).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    rows = items.select("vec").mapInArrow(gather, "i long, g array<double>").select("i", F.posexplode("g").alias("j", "g"))
    total = np.zeros((d, d))
    for r in rows.groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # d * d rows
        total[r.i, r.j] = r.g
    return total


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(query_id, rank, key, score): the k items with the largest integer product for every query row, without the query's own key.

    ``vec`` is an array of long. Rows with a null key or vector take no part. Ties go to the smaller key; with fewer than k items all are
    returned. Rows that repeat a key and vector count once; a key with two vectors counts as two items (and asks twice if it is a query, with
    one list of results for both). Vectors of unequal length are filled up with zeros. No queries or no items give no rows. Products must
    fit 63 bits.
    """
    spark = vectors.sparkSession
    wb.bounded_batches(spark)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(
        F.col(key).alias("id"), F.col(vec).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = cut(rows.dropDuplicates(["id", "vec"]).withColumn("norm", norm))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.LongType())])
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.count_if("asks").alias("q")).first()
    d = size.d or 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    if not size.q:
        found = spark.createDataFrame([], schema)
    else:
        found = _search(rows, size.n, size.q, d, k, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")


def _search(rows: DataFrame, n: int, q: int, d: int, k: int, schema: T.StructType) -> DataFrame:
    spark = rows.sparkSession
    values, axes = np.linalg.eigh(_moments(rows, d))
    axes, values = axes[:, ::-1], np.maximum(values[::-1], 0)
    carried = np.cumsum(values) / max(values.sum(), 1e-300)
    front = int(min(d, max(1, np.searchsorted(carried, 0.7) + 1)))
    head = rows.orderBy(F.desc("norm"), "id").limit(HEAD).select("id", "vec").collect()
    head_ids = [r.id for r in head]
    head_vecs = np.array([list(r.vec) + [0] * (d - len(r.vec)) for r in head], np.int64).reshape(len(head), d)
    shared = spark.sparkContext.broadcast((axes, front, head_ids, head_vecs))

    cuts = rows.agg(F.percentile_approx("norm", [i / LEVELS for i in range(LEVELS - 1, 0, -1)], 10000)).first()[0]
    level = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("norm") < c))
    levels = rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).orderBy("level").collect()
    firsts, counts, longest, total = {}, {}, [], 0
    for r in levels:
        counts[r.level] = -(-r.n // BLOCK)
        firsts[r.level] = total
        total += counts[r.level]
        longest.append((r.longest, total))
    table = spark.createDataFrame([(lv, firsts[lv], counts[lv]) for lv in firsts], "level int, first int, blocks int")
    splits = -(-q // SPLIT)

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, ids, vecs = shared.value
        place = {}
        for i, x in enumerate(ids):
            place.setdefault(x, []).append(i)
        for batch in batches:
            m = _matrix(batch.column("vec"), d)
            least, upto = [], []
            for x, v, length in zip(batch.column("id").to_pylist(), m, batch.column("norm").to_pylist()):
                scores = np.delete(vecs @ v, place.get(x, []))
                t = float(np.partition(scores, -k)[-k]) if len(scores) >= k else -np.inf
                least.append(t)
                # A class is visited while its longest item can reach the threshold; a negative threshold is reached by all.
                upto.append(max((b for top, b in longest if top * length * (1 + 1e-9) >= t - SLACK), default=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), batch.column("norm"), pa.array(least), pa.array(upto, pa.int32())],
                ["id", "vec", "norm", "least", "upto"])

    place_schema = T.StructType([rows.schema["id"], rows.schema["vec"], rows.schema["norm"], T.StructField("least", T.DoubleType()), T.StructField("upto", T.IntegerType())])
    asked = rows.where("asks").select("id", "vec", "norm").mapInArrow(thresholds, place_schema).where("upto > 0")
    split = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(splits)).cast("int")
    columns = ["block", "split", "role", "id", "vec", "norm", "least"]
    guests = asked.select(F.explode(F.sequence(F.lit(0), F.col("upto") - 1)).alias("block"), split.alias("split"), F.lit(1).alias("role"), "id", "vec", "norm", "least")
    hosts = rows.withColumn("level", level).join(F.broadcast(table), "level")  # LEVELS rows
    hosts = hosts.select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("role"), "id", "vec", "norm", F.lit(0.0).alias("least"))
    laid = hosts.select(*columns).unionByName(guests.select(*columns)).repartition("block", "split")
    laid = laid.sortWithinPartitions("block", "split", "role", F.desc("norm"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes_, front_, _, _ = shared.value
        at, parts, host = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("block", "split", "role")], axis=1)
            turns = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *turns], [*turns, len(marks)]):
                side = _Side(batch.slice(a, b - a), axes_, front_, d)
                if tuple(marks[a, :2]) != at:
                    at, parts, host = tuple(marks[a, :2]), [], None
                if marks[a, 2] == 0:
                    parts.append(side)
                elif parts:
                    host = host or _Side.joined(parts)
                    yield host.best_for(side, k, schema)

    return laid.mapInArrow(meet, schema)


class _Side:
    """Vectors of one block: as integers, and rotated with the lengths of what follows the front coordinates."""

    names = ("ids", "vecs", "norm", "front", "rest", "least")

    def __init__(self, batch: pa.RecordBatch, axes: np.ndarray, front: int, d: int):
        self.ids = np.array(batch.column("id").to_pylist())
        self.vecs = _matrix(batch.column("vec"), d)
        self.norm = batch.column("norm").to_numpy()
        turned = self.vecs @ axes
        self.front = turned[:, :front]
        self.rest = np.linalg.norm(turned[:, front:], axis=1)
        self.least = batch.column("least").to_numpy().copy()

    @classmethod
    def joined(cls, parts: list[_Side]) -> _Side:
        out = cls.__new__(cls)
        for name in cls.names:
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        return out

    def best_for(self, asks: _Side, k: int, schema: T.StructType) -> pa.RecordBatch:
        bq, bi, bs = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        least = asks.least.copy()
        for a in range(0, len(self.ids), STRIP):
            strip = slice(a, a + STRIP)
            live = np.flatnonzero(asks.norm * self.norm[a] * (1 + 1e-9) >= least - SLACK)
            bound = asks.front[live] @ self.front[strip].T
            bound += asks.rest[live][:, None] * self.rest[strip][None, :] * (1 + 1e-9)
            bound += 1e-9 * (1 + np.abs(bound))
            x, y = np.nonzero(bound >= least[live][:, None] - SLACK)
            x, y = live[x], y + a
            other = self.ids[y] != asks.ids[x]
            x, y = x[other], y[other]
            scores = [np.einsum("ij,ij->i", asks.vecs[x[i:i + PAIRS]], self.vecs[y[i:i + PAIRS]]) for i in range(0, len(x), PAIRS)]
            bq, bi, bs = np.concatenate((bq, x)), np.concatenate((bi, y)), np.concatenate((bs, *scores))
            order = np.lexsort((self.ids[bi], -bs, bq))
            bq, bi, bs = bq[order], bi[order], bs[order]
            rank = np.arange(len(bq)) - np.searchsorted(bq, bq, "left")
            full = bq[rank == k - 1]
            least[full] = np.maximum(least[full], bs[rank == k - 1])
            bq, bi, bs = bq[rank < k], bi[rank < k], bs[rank < k]
        return pa.RecordBatch.from_arrays([pa.array(asks.ids[bq]), pa.array(self.ids[bi]), pa.array(bs)], ["query_id", "id", "score"])
