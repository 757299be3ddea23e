"""Listings arriving as a stream, with image reuse counted as a batch over all of them would.

The newest row of every listing is kept as numbered changes beside the counts. A newer row is a change: it takes one from the count of the image
before and adds one to the count of its own, so two listings of one batch that share an image count each other, a listing that comes again does
not count twice, and an older or repeated row changes nothing. The changes of a batch are stored under its number, their counts are summed per
image before they move, and every listing whose image's count has changed is scored again. After any number of batches the table equals the one
computed at once from all rows.

A batch is joined with the newest rows of the batches before it, so no row is handled in Python and a batch run again sees what it saw the first time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from listingscope.operators.dedupe import keep_last
from listingscope.operators.images import FAILED_HASH
from listingscope.sources.store import ListingStore, _children

BATCH = "batch_no"


def changes(rows: DataFrame, key: str = "listing_id", time: str = "event_time", delay: str = "1 hour", event: str | None = None) -> DataFrame:
    """Rows of a stream that can change a listing: those without key or time are left out.

    ``time`` is a timestamp. With ``event``, the id of an arrival, arrivals sent again within ``delay`` are dropped and what is later than ``delay`` is
    ignored.
    """
    whole = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    return whole.dropDuplicatesWithinWatermark([event]) if event else whole


def newest(rows: DataFrame, key: str = "listing_id", time: str = "event_time", image: str = "image_hash") -> DataFrame:
    """One row per key: the newest, and of rows with one time the one with the greatest image."""
    return keep_last(rows.withColumn("_image", F.coalesce(image, F.lit(""))), [key], [time, "_image"]).drop("_image")


class Newest:
    """The newest row per listing as numbered changes; every ``fold`` batches they are reduced to a new base."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "listing_id", time: str = "event_time", image: str = "image_hash", fold: int = 100):
        self.spark, self.path, self.schema, self.key, self.time, self.image, self.fold = spark, path, schema, key, time, image, fold

    def read(self, below: int = sys.maxsize) -> DataFrame:
        """The newest rows after the batches below this number."""
        bases = {n: p for n, p in _done(self.spark, self.path, "base").items() if n < below}
        base = max(bases, default=-1)
        paths = [p for n, p in _done(self.spark, self.path, "batch").items() if base < n < below] + [p for n, p in bases.items() if n == base]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return newest(rows, self.key, self.time, self.image)

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """Rows of a batch that are newer than any before of their key, stored with ``previous_image``; a batch added again replaces itself."""
        columns = self.schema.names
        arrived = newest(batch, self.key, self.time, self.image)
        held = self.read(number).select(self.key, F.col(self.time).alias("_time"), F.col(self.image).alias("previous_image"))
        place = F.struct(F.col(self.time), F.coalesce(self.image, F.lit("")))
        newer = arrived.join(held, self.key, "left").where(F.col("_time").isNull() | (place > F.struct(F.col("_time"), F.coalesce("previous_image", F.lit("")))))
        folder = f"{self.path}/batch={number:012d}"
        newer.select(*columns, "previous_image").write.mode("overwrite").parquet(folder)
        if number - max(_done(self.spark, self.path, "base"), default=-1) >= self.fold:
            self.read(number + 1).write.mode("overwrite").parquet(f"{self.path}/base={number:012d}")
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("previous_image", self.schema[self.image].dataType)])).parquet(folder)


def _done(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """The finished folders of one kind by their numbers."""
    names = [n for n in _children(spark, path) if n.startswith(f"{kind}=")]
    return {int(n.split("=")[1]): f"{path}/{n}" for n in names if "_SUCCESS" in _children(spark, f"{path}/{n}")}


class ImageCounts:
    """Listings per image as sums of numbered changes; every ``fold`` batches they are added up to a new base."""

    def __init__(self, spark: SparkSession, path: str, image: str = "image_hash", fold: int = 100):
        self.spark, self.path, self.image, self.fold = spark, path, image, fold

    def _done(self, kind: str) -> dict[int, str]:
        return _done(self.spark, self.path, kind)

    def add(self, changed: DataFrame, number: int) -> None:
        """The changes of a batch; a batch added again replaces itself."""
        both = changed.select(F.explode(F.array(
            F.struct(F.col(self.image).alias(self.image), F.lit(1).alias("n")),
            F.struct(F.col("previous_image").alias(self.image), F.lit(-1).alias("n")))).alias("c")).select("c.*")
        valid = both.where(F.col(self.image).isNotNull() & (F.col(self.image) != FAILED_HASH))
        summed = valid.groupBy(self.image).agg(F.sum("n").alias("n")).where("n <> 0")
        summed.write.mode("overwrite").parquet(f"{self.path}/delta={number:012d}")
        bases = self._done("base")
        if number - max(bases, default=-1) >= self.fold:
            self._sum(number).write.mode("overwrite").parquet(f"{self.path}/base={number:012d}")

    def _sum(self, upto: int) -> DataFrame:
        bases = {n: p for n, p in self._done("base").items() if n < upto}
        base = max(bases, default=-1)
        paths = [p for n, p in self._done("delta").items() if base < n <= upto] + [p for n, p in bases.items() if n == base]
        schema = T.StructType([T.StructField(self.image, T.StringType()), T.StructField("n", T.LongType())])
        parts = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return parts.groupBy(self.image).agg(F.sum("n").alias("n")).where("n <> 0")

    def read(self, upto: int = sys.maxsize) -> DataFrame:
        """(image, image_reuse) after the batches up to this number."""
        return self._sum(upto).withColumnRenamed("n", "image_reuse")


def scored_table(spark: SparkSession, path: str, key: str = "listing_id", time: str = "event_time") -> ListingStore:
    """The table of ``start``: of a listing's rows the newest, and of its scores that of the last batch."""
    return ListingStore(spark, f"{path}/table", key, (time, BATCH))


def start(spark: SparkSession, arriving: DataFrame, path: str, scored: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "listing_id",
          time: str = "event_time", image: str = "image_hash", name: str = "listings", **options) -> StreamingQuery:
    """Process what has arrived of the stream, then stop; run again to go on from there.

    ``scored`` adds columns to rows with ``image_reuse``. Everything a batch writes is named after its number, so a batch repeated after a lost
    executor or driver replaces itself.
    """
    counts, table = ImageCounts(spark, f"{path}/counts", image), scored_table(spark, path, key, time)
    columns = arriving.columns
    state = Newest(spark, f"{path}/changes", arriving.schema, key, time, image)

    def write(batch: DataFrame, number: int) -> None:
        fresh = state.add(batch, number)
        counts.add(fresh, number)
        moved = fresh.select(F.col(image).alias("_i")).unionByName(fresh.select(F.col("previous_image").alias("_i"))).where(
            F.col("_i").isNotNull() & (F.col("_i") != FAILED_HASH)).distinct()
        others = state.read(number).join(moved, F.col(image) == F.col("_i"), "left_semi").join(fresh.select(key), key, "left_anti")
        rows = fresh.select(columns).unionByName(others.select(columns))
        reuse = counts.read(number)
        rows = rows.join(reuse, image, "left").withColumn("image_reuse", F.coalesce("image_reuse", F.lit(0)))
        table.upsert(scored(rows).withColumn(BATCH, F.lit(number)), f"{name}-{number:012d}")

    return (
        changes(arriving, key, time, **options).writeStream.queryName(name).foreachBatch(write).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def at_once(rows: DataFrame, scored: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("listing_id",), time: str = "event_time", image: str = "image_hash") -> DataFrame:
    """What ``start`` leaves in its table, computed from all rows in one batch."""
    from listingscope.operators.images import with_reuse

    known = rows.where(F.col(time).isNotNull() & F.col(keys[0]).isNotNull()).withColumn("_image", F.coalesce(image, F.lit("")))
    return scored(with_reuse(keep_last(known, list(keys), [time, "_image"]).drop("_image"), image))
