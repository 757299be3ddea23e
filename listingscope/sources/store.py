"""Where stage results and the report table live.

``Snapshots`` keeps whole versions of a stage's output. ``ListingStore`` is the
report table with upserts: arrivals are written beside the base as small
batches and laid over it when read, so an upsert costs its own rows and not
the table. ``compact`` writes a new base; the old generation is the backup.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingscope.functions.columns import csv_text
from listingscope.operators.dedupe import keep_last


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark can reach; [] if absent."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


class Snapshots:
    """Whole versions under ``path/snapshot=<name>``; the greatest finished name is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def names(self) -> list[str]:
        found = [n for n in _children(self.spark, self.path) if n.startswith("snapshot=")]
        return [n.removeprefix("snapshot=") for n in found if "_SUCCESS" in _children(self.spark, f"{self.path}/{n}")]

    def write(self, df: DataFrame, name: str | None = None) -> str:
        name = name or datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
        df.write.mode("errorifexists").parquet(f"{self.path}/snapshot={name}")
        return name

    def read(self, name: str | None = None) -> DataFrame:
        names = self.names()
        if not names:
            raise FileNotFoundError(f"no finished snapshot under {self.path}")
        return self.spark.read.parquet(f"{self.path}/snapshot={name or names[-1]}")


def overlay(base: DataFrame, arrivals: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` whose key has not arrived, and all arrivals."""
    kept = base.join(arrivals.select(key), key, "left_anti")
    return kept.unionByName(arrivals, allowMissingColumns=True)


class ListingStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "listing_id", order: Sequence[str] = ("ingested_at",)):
        self.spark, self.path, self.key, self.order = spark, path, key, list(order)

    def _generation(self) -> int:
        found = [n for n in _children(self.spark, self.path) if n.startswith("gen=")]
        done = [int(n.removeprefix("gen=")) for n in found if "_SUCCESS" in _children(self.spark, f"{self.path}/{n}/base")]
        return max(done, default=0)

    def _folder(self, generation: int) -> str:
        return f"{self.path}/gen={generation:06d}"

    def _batches(self, generation: int) -> list[str]:
        folder = f"{self._folder(generation)}/delta"
        return [f"{folder}/{n}" for n in _children(self.spark, folder) if "_SUCCESS" in _children(self.spark, f"{folder}/{n}")]

    def upsert(self, rows: DataFrame, batch: str) -> None:
        """Every row with an id of ``rows`` is replaced; the table is made if absent.

        A batch name written twice replaces itself, so a repeated stream batch
        changes nothing.
        """
        newest = keep_last(rows, [self.key], self.order)
        newest.write.mode("overwrite").parquet(f"{self._folder(self._generation())}/delta/batch={batch}")

    def read(self) -> DataFrame:
        generation = self._generation()
        batches = self._batches(generation)
        base = self.spark.read.parquet(f"{self._folder(generation)}/base") if generation else None
        if not batches:
            if base is None:
                raise FileNotFoundError(f"no table under {self.path}")
            return base
        arrivals = self.spark.read.option("mergeSchema", True).parquet(*batches)
        arrivals = keep_last(arrivals, [self.key], self.order)
        if base is None:
            return arrivals
        return overlay(base, arrivals, self.key)

    def compact(self) -> None:
        """Fold the batches into a new base. Run it while nothing is being written."""
        table = self.read()
        table.write.mode("errorifexists").parquet(f"{self._folder(self._generation() + 1)}/base")

    def get(self, key_value) -> DataFrame:
        """The row of one id, or none; the id reaches the file scan as a filter."""
        return self.read().where(F.col(self.key) == key_value)


# ---------------------------------------------------------------- exports

def csv_safe(df: DataFrame) -> DataFrame:
    """Columns in name order, whole text on one line, nested values as JSON text."""
    def cell(name: str):
        kind = df.schema[name].dataType.typeName()
        if kind == "string":
            return csv_text(F.col(name)).alias(name)
        if kind in ("array", "map", "struct"):
            return F.to_json(name).alias(name)
        return F.col(name)

    return df.select(*[cell(c) for c in sorted(df.columns)])


def write_csv(df: DataFrame, path: str) -> None:
    csv_safe(df).write.option("header", True).option("escape", '"').csv(path)


def export_summary(df: DataFrame) -> DataFrame:
    """Counts over listings with ``n_all_reviews``, one row each."""
    n = F.col("n_all_reviews")
    return df.agg(
        F.count(F.lit(1)).alias("products"), F.count(F.when(n > 0, 1)).alias("with_reviews"),
        F.count(F.when(n == 0, 1)).alias("without_reviews"), F.coalesce(F.sum(n), F.lit(0)).alias("reviews"))


def write_json(df: DataFrame, path: str) -> None:
    """Records under ``path/records`` and the one-row header under ``path/summary``."""
    df.write.json(f"{path}/records")
    stamped = export_summary(df).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    stamped.write.json(f"{path}/summary")
