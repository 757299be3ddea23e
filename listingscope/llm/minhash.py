"""Near duplicates by fast similarity sketching, banding and an exact check of whole shingle sets.

A document is the set of its distinct k-word shingles, as 64-bit hashes. A sketch has COORDINATES bins. In round r < COORDINATES every
element falls into a hashed bin with a hashed value; in round COORDINATES + i every element falls into bin i. A bin keeps the value of the
first round that reaches it, so every coordinate fills, also for a set of one element, and the share of equal coordinates of two sketches
estimates the Jaccard similarity with Chernoff bounds.

Sketches are cut into BANDS bands of ROWS coordinates. Documents that agree in a band are candidates: two sets with similarity 0.8 agree in
none of 32 bands of 4 with a chance of (1 - 0.8^4)^32 = 5e-8. Candidates of which fewer than 60 % of the coordinates agree are left out
(5.7 standard deviations below 0.8: about 1e-8); all others are compared as whole sets.

Only components are wanted, so pairs known to be connected are not compared again:
1. equal sets are folded into their smallest document;
2. each member of a bucket is compared with the bucket's smallest document, which gives first components;
3. in buckets that still hold several components, every document outside the largest one is compared with all documents of other components.
A bucket is dealt over blocks of bounded size, and the partners of a document over chunks, so no group meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb
from listingscope.llm.links import smallest_reachable
from listingscope.session import cut, discard

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
LEAST_EQUAL = 0.6 * COORDINATES
CHUNK, BLOCK, GUESTS = 64, 512, 4096
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- sketches

def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle, no words none."""
    w = wb.words(texts, wb.BLANK_SEPARATED)
    hashed = wb.hashes(w.data, w.starts, w.ends)
    shingles = wb.runs(hashed, k)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= k:
            s = np.sort(shingles[a:b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(np.array([wb.whole(hashed[a:b])] if b > a else [], np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each coordinate, a row for each set; sets may not be empty."""
    n, t = len(sets), COORDINATES
    bins = np.full(n * t, _EMPTY, np.uint64)
    values = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    for r in range(2 * t):
        if not len(values):
            break
        drawn = wb.mix(values ^ wb.mix(np.array([r + 1], np.uint64)))
        place = owner * t + ((drawn & np.uint64(t - 1)).astype(np.int64) if r < t else r - t)
        # The round leads, so a bin keeps what its first round brought.
        np.minimum.at(bins, place, (drawn >> np.uint64(8)) | np.uint64(r << 56))
        open_ = (bins.reshape(n, t) == _EMPTY).any(axis=1)
        keep = open_[owner]
        if not keep.all():
            values, owner = values[keep], owner[keep]
    return (wb.mix(bins) >> np.uint64(48)).astype(np.uint16).reshape(n, t)


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, digest, sketch): digest and sketch are null for a text without words."""
    wb.bounded_batches(docs.sparkSession)
    schema = T.StructType([
        T.StructField("id", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch, "t"):
                sets = shingle_sets(part.column("t"), words)
                full = iter(sketches([s for s in sets if len(s)]))
                rows = [(len(s), hashlib.blake2b(s, digest_size=16).digest(), next(full).tobytes()) if len(s) else (0, None, None) for s in sets]
                n, digest, sketch = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())],
                    ["id", "n_shingles", "digest", "sketch"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(sign, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit bands."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u8").reshape(len(column), BANDS)


def _bucket_keys(bands: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = wb.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        return wb.mix(bands + salt).view(np.int64)


def _buckets(reps: DataFrame) -> DataFrame:
    """(bucket, band, id): one row per band of each document."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("band", T.IntegerType()), reps.schema["id"]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = _bucket_keys(_matrix(batch.column("sketch")))
            row = pa.array(np.repeat(np.arange(n), BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), batch.column("id").take(row)],
                ["bucket", "band", "id"])

    return reps.select("id", "sketch").mapInArrow(deal, schema)


# ---------------------------------------------------------------- candidates

def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    sizes = reps.select("id", "n_shingles", "sketch")
    both = pairs.join(sizes.toDF("a", "na", "sa"), "a").join(sizes.toDF("b", "nb", "sb"), "b")
    both = both.where(_sizes_fit(F.col("na"), F.col("nb"), percent))
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_matrix(batch.column("sa")).view("<u2") == _matrix(batch.column("sb")).view("<u2")).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(equal >= LEAST_EQUAL))

    return both.select("a", "b", "sa", "sb").mapInArrow(compare, schema)


def _sizes_fit(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _across(reps: DataFrame, crowded: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Seats of documents of different components that share a bucket and may be similar; a pair sits together in one block only.

    A bucket's documents are hosts, about BLOCK in a block; those outside the largest component are guests of every block. A block with
    more than about GUESTS guests is repeated, each time with a part of them.
    """
    known = reps.join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    known = known.select("id", "n_shingles", "sketch", F.coalesce("component", "id").alias("component"))
    dealt = cut(crowded.join(known.select("id", "component"), "id"))
    per_part = dealt.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_part.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("major"))
    mixed = mixed.where("n > most").select(
        "bucket", "major", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / GUESTS).cast("int").alias("slots"))
    rows = dealt.join(mixed, "bucket").join(known.drop("component"), "id")
    columns = ["bucket", "block", "role", "band", "id", "component", "n_shingles", "sketch", "major"]
    seat = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int") * F.col("slots")
    hosts = rows.withColumn("block", F.explode(F.sequence(seat, seat + F.col("slots") - 1))).withColumn("role", F.lit(0))
    slot = F.pmod(F.xxhash64("id", F.lit(1)), F.col("slots")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b * F.col("slots") + slot)
    guests = rows.where("component <> major").withColumn("block", F.explode(every)).withColumn("role", F.lit(1))
    laid = hosts.select(*columns).unionByName(guests.select(*columns))
    laid = laid.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role")
    schema = _seats_schema(reps.schema["id"].dataType, T.LongType())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, host, wanted = None, [], None, None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "role"))))
            start = 0
            while start < len(marks):
                stop = start
                while stop < len(marks) and marks[stop] == marks[start]:
                    stop += 1
                run = _Run(batch.slice(start, stop - start))
                if marks[start][:2] != at:
                    if host is not None:
                        yield from _seats(at, 0, host.ids[wanted], [[]] * int(wanted.sum()), batch.schema.field("id").type)
                    at, parts, host = marks[start][:2], [], None
                if marks[start][2] == 0:
                    parts.append(run)
                else:
                    if host is None:
                        host = _Run.joined(parts)
                        wanted = np.zeros(len(host.ids), bool)
                    ids, partners = host.partners_of(run, percent, wanted)
                    yield from _seats(at, 1, ids, partners, batch.schema.field("id").type)
                start = stop
        if host is not None:
            kind = pa.array(host.ids).type
            yield from _seats(at, 0, host.ids[wanted], [[]] * int(wanted.sum()), kind)

    return laid.mapInArrow(meet, schema)


def _seats_schema(kind: T.DataType, group: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("group", group), T.StructField("block", T.IntegerType()), T.StructField("role", T.IntegerType()),
        T.StructField("id", kind), T.StructField("partners", T.ArrayType(kind))])


def _seats(at: tuple, role: int, ids, partners: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    if len(ids):
        yield pa.RecordBatch.from_arrays(
            [pa.array([at[0]] * len(ids), pa.int64()), pa.array([at[1]] * len(ids), pa.int32()), pa.array([role] * len(ids), pa.int32()),
             pa.array(ids, kind), pa.array(partners, pa.list_(kind))], ["group", "block", "role", "id", "partners"])


class _Run:
    """Documents of one block of a bucket as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = np.array(batch.column("id").to_pylist())
        self.parts = np.array(batch.column("component").to_pylist())
        self.sizes = batch.column("n_shingles").to_numpy()
        self.bands = _matrix(batch.column("sketch"))
        self.band = batch.column("band")[0].as_py()
        self.major = batch.column("major")[0].as_py()

    @classmethod
    def joined(cls, runs: list[_Run]) -> _Run:
        out = cls.__new__(cls)
        for name in ("ids", "parts", "sizes", "bands"):
            setattr(out, name, np.concatenate([getattr(r, name) for r in runs]))
        out.band, out.major = runs[0].band, runs[0].major
        return out

    def partners_of(self, guests: _Run, percent: int, wanted: np.ndarray) -> tuple[list, list]:
        """Guests with partners among the hosts, and these; marks the hosts in ``wanted``."""
        coordinates, ids, partners = self.bands.view("<u2"), [], []
        for i in range(len(guests.ids)):
            near = (self.parts != guests.parts[i]) & (np.minimum(self.sizes, guests.sizes[i]) * 100 >= np.maximum(self.sizes, guests.sizes[i]) * percent)
            # Two guests meet twice, and documents may share several bands: one place counts.
            near &= (self.parts == self.major) | (self.ids > guests.ids[i])
            near = np.flatnonzero(near)
            near = near[(coordinates[near] == guests.bands[i].view("<u2")).sum(axis=1) >= LEAST_EQUAL]
            if len(near):
                near = near[(self.bands[near] == guests.bands[i]).argmax(axis=1) == self.band]
            if len(near):
                wanted[near] = True
                ids.append(guests.ids[i])
                partners.append(self.ids[near])
        return ids, partners


# ---------------------------------------------------------------- exact check

def _star_seats(pairs: DataFrame) -> DataFrame:
    """Seats of pairs (a, b): a hosts its partners, of which a block holds about CHUNK."""
    crowd = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(crowd, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("block"))
    guests = dealt.select(F.col("a").alias("group"), "block", F.lit(1).alias("role"), F.col("b").alias("id"), F.array("a").alias("partners"))
    hosts = dealt.select("a", "block").distinct().select(F.col("a").alias("group"), "block", F.lit(0).alias("role"), F.col("a").alias("id"))
    return guests.unionByName(hosts.withColumn("partners", F.array().cast(guests.schema["partners"].dataType)))


def _linked(seats: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """Pairs (a, b) of guests and partners with 100 * |A and B| >= percent * |A or B| on whole sets, recomputed from the texts.

    The texts are always joined by a shuffle: the join's data then grows with the table and does not jump where a broadcast ends.
    """
    kind = docs.schema[key].dataType
    seats = cut(seats)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null").join(seats.hint("merge"), "id")
    columns = ["group", "block", "role", "id", "partners"]
    schema = T.StructType([*(seats.schema[c] for c in columns), T.StructField("set", T.BinaryType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch, "t"):
                sets = [s.tobytes() for s in shingle_sets(part.column("t"), words)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(sets, pa.binary())], [*columns, "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hosts = None, {}
        for batch in batches:
            found = []
            for group, block, role, id_, partners, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (group, block) != at:
                    at, hosts = (group, block), {}
                own = np.frombuffer(data, np.uint64)
                if role == 0:
                    hosts.setdefault(id_, []).append(own)
                else:
                    found += [(id_, p) for p in partners if any(_similar(x, own, percent) for x in hosts.get(p, ()))]
            if found:
                a, b = zip(*found)
                type_ = batch.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(a, type_), pa.array(b, type_)], ["a", "b"])

    sets = texts.select(*columns, "t").mapInArrow(gather, schema)
    sets = sets.repartition("group", "block").sortWithinPartitions("group", "block", "role")
    linked = cut(sets.mapInArrow(check, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])))
    discard(seats)
    return linked


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


# ---------------------------------------------------------------- the operator

def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``; other columns of docs are not read.

    ``component_id`` is the smallest key reachable over links, ``kept`` marks the row whose key it is. A text that is null or has no words
    has an empty set, no links and its own key. Equal rows get equal results; rows that repeat a key with another text are judged by their own
    text. A row without key takes no part: its component is null and it is kept. An empty table gives an empty table. ``percent`` below 80
    would need other bands and is refused.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bands are made for similarities of 80 % and more")
    signed = cut(signatures(docs, words, key, text))
    reps = cut(signed.where("id is not null and digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    dealt = _buckets(reps)
    crowds = dealt.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "a")
    crowded = cut(dealt.join(crowds, "bucket"))
    stars = crowded.where("id > a").select("a", F.col("id").alias("b")).distinct()
    near = _linked(_star_seats(cut(_likely(stars, reps, percent))), docs, words, percent, key, text)
    labels = cut(smallest_reachable(near))
    more = _linked(_across(reps, crowded.drop("a"), labels, percent), docs, words, percent, key, text)
    steps = more.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = smallest_reachable(steps).toDF("component", "root")
    whole = labels.join(merged, "component", "left").select(F.col("node").alias("id"), F.coalesce("root", "component").alias("component"))
    # A document that is no end of a first link may still have got a component from a later one.
    late = merged.join(labels.select(F.col("node").alias("component")), "component", "left_anti").toDF("id", "component")
    roots = whole.unionByName(late)
    by_digest = reps.join(roots, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = signed.join(by_digest, "digest", "left").withColumn(
        "component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", kept.alias("kept"))
