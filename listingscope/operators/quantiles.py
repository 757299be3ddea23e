"""Exact quantiles, histograms and summaries without a global sort or one big group.

The built-in exact percentile keeps every distinct value of a group in one
task. Here approximate quantiles fence in the place of each one asked for; values
inside a fence are counted one by one and ranked, those between fences only
counted. A fence that missed its place is seen by the counts and drawn wider.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingscope.session import cut, discard

ACCURACY = 10_000
BUCKETS = 2_500      # a fence is two of so many parts of a group wide, four times what the approximation may be off to each side
SMALL = 100_000      # values of a group that are all kept


def _fences(probs: Iterable[float], buckets: int) -> list[tuple[float, bool]]:
    """Ends of the fences in ascending order as (share, opens); one at or beyond an end of the values is left out."""
    spans: list[list[float]] = []
    for p in sorted(set(probs)):
        low, high = p - 1 / buckets, p + 1 / buckets
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    return [(share, opens) for span in spans for share, opens in zip(span, (True, False)) if 0 < share < 1]


def _counted(rows: DataFrame, value: str, probs: Iterable[float], by: list[str], buckets: int) -> DataFrame:
    """(by, _total, _slot, _key, _n, _low, _high): each value inside a fence with its count, and one row for all values between two fences."""
    ends = _fences(probs, buckets)
    aggregates = [F.count(F.lit(1)).alias("_total")]
    if ends:
        aggregates.append(F.percentile_approx(value, F.array(*[F.lit(share) for share, _ in ends]), F.lit(ACCURACY)).alias("_cuts"))
    # Fixed once: approximate quantiles may differ from run to run.
    bounds = cut(rows.groupBy(*by).agg(*aggregates))
    bounds = bounds.select(*by, "_total", *[F.get("_cuts", F.lit(i)).alias(f"_c{i}") for i in range(len(ends))])
    known = rows.join(bounds, by) if by else rows.crossJoin(F.broadcast(bounds))
    # The ends belong to the fence, so equal ends still hold their value.
    passed = [F.when((F.col(value) >= F.col(f"_c{i}")) if opens else (F.col(value) > F.col(f"_c{i}")), 1).otherwise(0) for i, (_, opens) in enumerate(ends)]
    fenced = [0] if not ends or not ends[0][1] else []
    fenced += [i for i, (_, opens) in enumerate(ends, start=1) if opens]
    placed = known.select(*by, value, "_total", sum(passed, F.lit(0)).alias("_slot"))
    key = F.when(F.col("_slot").isin(fenced) | (F.col("_total") <= SMALL), F.col(value))
    return placed.withColumn("_key", key).groupBy(*by, "_total", "_slot", "_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """One row per group; each quantile is interpolated between its neighbours."""
    return _quantiles(cut(df.select(*by, value)), value, probs, list(by), buckets)


def _quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str], buckets: int | None = None) -> DataFrame:
    """``exact_quantiles`` of rows that are cheap to read twice."""
    rows, buckets = df.where(F.col(value).isNotNull()).select(*by, value), buckets or BUCKETS
    while True:
        counts = cut(_counted(rows, value, probs.values(), by, buckets))
        found = cut(_picked(counts, probs, by))
        discard(counts)
        if buckets == 1 or found.where("_missed").isEmpty():
            return found.drop("_missed")
        discard(found)
        buckets = max(1, buckets // 4)


def _picked(counts: DataFrame, probs: dict[str, float], by: list[str]) -> DataFrame:
    sizes = counts.groupBy(*by, "_slot").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_slot").orderBy("_low").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(starts, [*by, "_slot"]).withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))

    def holds(place: Column) -> Column:
        """Whether a row holds a 0-based place of the group's sorted values."""
        return (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))

    picked, missed = [], F.lit(False)
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        picked += [F.max(F.when(holds(F.floor(place)), F.col("_low"))).alias(f"{name}_lo"), F.max(F.when(holds(F.ceil(place)), F.col("_low"))).alias(f"{name}_hi"),
                   F.max(place - F.floor(place)).alias(f"{name}_w")]
        missed = missed | holds(F.floor(place)) | holds(F.ceil(place))
    out = ranked.groupBy(*by).agg(*picked, F.coalesce(F.max(missed & (F.col("_low") < F.col("_high"))), F.lit(False)).alias("_missed"))
    return out.select(*by, *[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_w")).alias(n) for n in probs
    ], "_missed")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins absent."""
    ends = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("e"))
    known = df.where(F.col(value).isNotNull()).select(value).withColumn("_e", ends.scalar())
    spread = F.col("_e.hi") - F.col("_e.lo")
    place = F.when(spread == 0, 0).otherwise(F.floor((F.col(value) - F.col("_e.lo")) / spread * bins))
    binned = known.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, ends and the outermost values within 1.5 box widths."""
    rows = cut(df.where(F.col(value).isNotNull()).select(by, value))  # read three times below
    quartiles = _quantiles(rows, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    width = F.col("q3") - F.col("q1")
    fenced = rows.join(quartiles, by)
    low, high = F.col("q1") - 1.5 * width, F.col("q3") + 1.5 * width
    return fenced.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col(value) >= low, F.col(value))).alias("low_fence"),
        F.max(F.when(F.col(value) <= high, F.col(value))).alias("high_fence"),
    )


def describe(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max of several columns, one row each."""
    wide = cut(df.select(*[F.col(v).cast("double").alias(v) for v in values]))
    long = wide.unpivot([], list(values), "column", "value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return basic.join(_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"]), "column", "left")
