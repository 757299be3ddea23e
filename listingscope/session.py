"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINTS = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # Spark 4.1; older versions ignore it


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster use the session it gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("listingscope")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CHECKPOINTS, f"/tmp/listingscope-{uuid.uuid4().hex}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    Where none is named, a local session gets one of its own: all its tasks run on one machine. On a cluster a machine-local folder is lost
    with its machine, so the setting is asked for.
    """
    shared = spark.conf.get(CHECKPOINTS, "")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINTS} to a folder every executor can reach")
        shared = f"/tmp/listingscope-{spark.sparkContext.applicationId}"
        spark.conf.set(CHECKPOINTS, shared)
    return shared


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Batches for Python workers stay small in bytes as well as rows: whole pages and texts are long."""
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


_WRITTEN: dict[int, tuple[SparkSession, dict[str, None]]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, store it as a table and go on from the stored rows.

    A written table outlives lost executors, brings its size to the planner and starts the next plan afresh, which a loop of joins needs. It
    stays until ``discard`` or the end of the session. The shuffle files behind it go when it is written: else those of all steps stay on
    the executors' disks until the driver's memory happens to be cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    asked = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if asked is None else spark.conf.set(CLEANUP, asked)
    stored = spark.read.schema(df.schema).parquet(path)
    key = id(spark.sparkContext)
    if key not in _WRITTEN:
        _WRITTEN[key] = (spark, {})
    _WRITTEN[key][1][path] = None
    stored._listingscope_path = path
    return stored


def discard(stored: DataFrame) -> None:
    """Remove a table of ``cut`` that no later plan reads."""
    path = getattr(stored, "_listingscope_path", None)
    if path:
        _remove(stored.sparkSession, path)
        _WRITTEN[id(stored.sparkSession.sparkContext)][1].pop(path, None)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, paths in _WRITTEN.values():
        if spark.sparkContext._jsc is not None:
            for path in paths:
                _remove(spark, path)
