"""Connected components of links between documents, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingscope.session import cut, discard

ROUNDS = 60  # the rounds grow with the logarithm of the longest path; this stands for a fault, not for a size


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it reaches.

    Alternating large and small stars. Each round is a written table; the round before is removed.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark = _mark(stars)
    for _ in range(ROUNDS if mark[0] else 0):
        after = cut(_small_star(_large_star(stars)))
        discard(stars)
        stars, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    hung = stars.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return hung.unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v")
    return hung.unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
