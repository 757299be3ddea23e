"""One row per key, distinct values, per-key limits and positions.

``keep_first`` / ``keep_last`` aggregate instead of ranking: the partial
aggregate keeps one row per key and task, so a key that holds a third of the
table never meets in one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingscope.functions.columns import digits_to_long
from listingscope.session import cut


def _as_columns(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = pick(F.struct(*rest), F.struct(*_as_columns(order))).alias("_row")
    kept = df.dropna(subset=list(keys)).groupBy(*keys).agg(chosen)
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row of each key in ``order``; rows without a key are dropped.

    ``order`` should be total inside a key: of rows it leaves equal, any may stay. Whole rows are carried: select the columns wanted before the call.
    """
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return _keep(df, keys, order, F.max_by)


def latest(df: DataFrame, order: Sequence) -> DataFrame:
    """The single most recent row of the whole table."""
    everything = F.max_by(F.struct(*df.columns), F.struct(*_as_columns(order))).alias("_row")
    return df.agg(everything).where("_row is not null").select("_row.*")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """At most ``n`` rows per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_as_columns(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def drop_missing_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def typed_key(df: DataFrame, key: str) -> DataFrame:
    """Make a text key comparable with 64-bit ids of another table."""
    return df.withColumn(key, digits_to_long(F.col(key).cast("string")))


def without_used(df: DataFrame, column: str = "used") -> DataFrame:
    """Used items go, unknown stays."""
    return df.where(F.coalesce(F.col(column), F.lit(0)) != 1)


def dense_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0, 1, 2, … in ``order`` over the whole table without one global task.

    Rows are range-sorted and fixed once; each row's number is its place inside
    its part plus the rows of the parts before it. Only part sizes travel.
    """
    sorted_rows = cut(
        df.sort(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_offset")
    )
