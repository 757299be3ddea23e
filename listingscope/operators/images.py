"""Image reuse by hash value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingscope.functions.columns import count_where

FAILED_HASH = "ERRO"  # Fixed value: mark of an image that could not be hashed.


def hash_counts(images: DataFrame, column: str = "image_hash") -> DataFrame:
    valid = images.where(F.col(column).isNotNull() & (F.col(column) != FAILED_HASH))
    return valid.groupBy(column).agg(F.count(F.lit(1)).alias("image_reuse"))


def with_reuse(images: DataFrame, column: str = "image_hash", among: DataFrame | None = None) -> DataFrame:
    """Occurrences of each row's hash, in ``images`` or in all the rows of ``among``; failed and missing hashes have none.

    Counted and joined back rather than windowed: a hash shared by a third of
    all images then costs one partial count per task, and the join side that
    holds the hot value can be split at run time.
    """
    return images.join(hash_counts(images if among is None else among, column), column, "left").fillna({"image_reuse": 0})


def per_listing(hashed: DataFrame, key: str = "listing_id") -> DataFrame:
    """Several images per listing: the highest reuse and how many images."""
    return hashed.groupBy(key).agg(F.max("image_reuse").alias("image_reuse"), F.count(F.lit(1)).alias("n_images"))


def reuse_summary(images: DataFrame, column: str = "image_hash") -> DataFrame:
    return hash_counts(images, column).agg(
        F.count(F.lit(1)).alias("hashes"),
        count_where(F.col("image_reuse") > 1).alias("reused"),
        F.max("image_reuse").alias("top"),
    )


def most_reused(images: DataFrame, key: str, n: int = 5, column: str = "image_hash", samples: int = 3) -> DataFrame:
    """The ``n`` most reused hashes with their smallest sample ids.

    Samples are looked up only for the chosen hashes, and one minimum per step,
    so no hash's ids are gathered.
    """
    top = hash_counts(images, column).orderBy(F.desc("image_reuse"), column).limit(n)
    ids = images.join(F.broadcast(top), column, "left_semi").select(column, F.col(key).cast("string").alias("_id"))
    out = top
    for i in range(1, samples + 1):
        out = out.join(ids.groupBy(column).agg(F.min("_id").alias(f"sample_{i}")), column, "left")
        taken = out.select(F.col(column).alias("_h"), F.col(f"sample_{i}").alias("_t"))
        ids = ids.join(F.broadcast(taken), (F.col(column) == F.col("_h")) & (F.col("_id") > F.col("_t")), "left_semi")
    return out


def reuse_bands(hashed: DataFrame) -> DataFrame:
    n = F.col("image_reuse")
    band = (F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").otherwise(">10"))
    return hashed.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def download_summary(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
