"""New listings arriving as files, scored against the current tables and upserted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listingscope.functions.columns import MERGE_FILLS, fill
from listingscope.operators.rules import score
from listingscope.sources.store import ListingStore


def scorer(hash_counts: DataFrame | None = None, seller_features: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Score a batch with the reuse counts and seller graph known so far.

    Pass stored tables, so that each batch reads their current files. A listing
    whose image is new has a reuse of 1; a seller not in the graph has zeros.
    """
    def apply(batch: DataFrame) -> DataFrame:
        out = batch
        if hash_counts is not None:
            out = out.join(hash_counts.withColumnRenamed("image_reuse", "_known"), "image_hash", "left")
            out = out.withColumn("image_reuse", F.coalesce(F.col("_known") + 1, F.lit(1))).drop("_known")
        if seller_features is not None:
            out = fill(out.join(seller_features, "seller_id", "left"), MERGE_FILLS)
        return score(out)

    return apply


def start(
    spark: SparkSession,
    source: str,
    schema,
    store: ListingStore,
    scored: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    name: str = "listings",
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Process what has arrived, then stop; run again to go on from there.

    The batch is named after the stream and its number: a batch repeated after
    a lost executor overwrites itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        store.upsert(scored(batch), f"{name}-{number:012d}")

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        arriving.writeStream.queryName(name).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
