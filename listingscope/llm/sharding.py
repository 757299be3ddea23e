"""Shards of bounded size by extendible hashing.

Every row has a 60-bit hash of its key and text. A shard is a prefix of that hash: the directory starts with the empty prefix, and every bucket
whose bytes exceed the limit splits on the next bit, until all fit. The tree is found from sums: bytes are added up once per cell of a depth a
few bits finer than the limit asks for, and the cells' sums give all buckets above them. Only cells that are still too large are added up
again, a few bits deeper. A bucket of equal hashes (one oversized text, or equal rows) cannot be split; it is a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingscope.llm.columns import plain
from listingscope.session import cut

BITS = 60
LIMIT = 8 << 20     # bytes of text in a shard
FINER = 4


def row_hash(key: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of ``key:md5(text)``; nulls count as empty."""
    name = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(name, 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("_h", BITS - depth)


def directory(hashed: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(depth, (cell, shard, depth, shard_bytes, shard_rows))]: the shard of every cell at a depth; a cell that is missing is told deeper."""
    sums = [F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("_h").alias("low"), F.max("_h").alias("high")]
    total = hashed.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + FINER)
    top, told, rest = 0, [], hashed
    while True:
        cells = cut(rest.groupBy(_prefix(depth).alias("cell")).agg(*sums))
        up = cells.select("*", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("d"))
        up = up.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - d)"))
        nodes = up.groupBy("d", "prefix").agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = nodes.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high")) | (F.col("d") == BITS))
        # The shallowest bucket that fits is the shard.
        shard = up.select("cell", "d", "prefix").join(fits, ["d", "prefix"]).groupBy("cell").agg(
            F.min_by(F.struct("d", "prefix", "bytes", "rows"), "d").alias("s"))
        name = F.when(F.col("s.d") == 0, "").otherwise(F.expr("lpad(bin(s.prefix), s.d, '0')"))
        told.append((depth, cut(shard.select(
            "cell", name.alias("shard"), F.col("s.d").alias("depth"), F.col("s.bytes").alias("shard_bytes"), F.col("s.rows").alias("shard_rows")))))
        open_ = cells.join(told[-1][1], "cell", "left_anti").select("cell")
        if depth == BITS or open_.isEmpty():
            return told
        rest = rest.withColumn("cell", _prefix(depth)).join(open_, "cell", "left_semi").drop("cell")
        top, depth = depth + 1, min(BITS, depth + FINER)


def shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns and rows of docs with n_bytes, shard (a string of bits), depth, shard_bytes and shard_rows.

    Null and empty texts have 0 bytes and go where their hash says. Equal rows share a shard. A shard is above the limit only if all its
    rows have one hash. An empty table gives an empty table. Columns named like the new ones are replaced.
    """
    new = ["n_bytes", "shard", "depth", "shard_bytes", "shard_rows"]
    docs, kept, at = plain(docs, tuple(new))
    rows = docs.withColumn("n_bytes", F.coalesce(F.octet_length(at[text]), F.lit(0)).cast("bigint")).withColumn("_h", row_hash(F.col(at[key]), F.col(at[text])))
    out, names = rows, new[1:]
    for i, (depth, cells) in enumerate(directory(rows.select("n_bytes", "_h"), limit)):
        told = cells.select(F.col("cell").alias("_cell"), *(F.col(n).alias(f"_{n}{i}") for n in names))
        out = out.withColumn("_cell", _prefix(depth)).join(told, "_cell", "left").drop("_cell")
        for n in names:
            found = F.col(f"_{n}{i}")
            out = out.withColumn(n, F.coalesce(F.col(n), found) if i else found).drop(f"_{n}{i}")
    return out.select(*docs.columns, *new).toDF(*kept, *new)


def write(sharded: DataFrame, path: str) -> None:
    """One folder per shard."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def shards_sql(limit: int = LIMIT) -> str:
    """The same shards in DuckDB: all prefixes of all hashes, of which the shortest that fits is taken."""
    return f"""
WITH hashed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), {BITS // 4}) AS BIGINT) AS h
  FROM documents),
above AS (SELECT *, d, h >> ({BITS} - d) AS prefix FROM hashed, (SELECT unnest(range(0, {BITS + 1})) AS d)),
nodes AS (
  SELECT d, prefix, sum(n_bytes) AS bytes, count(*) AS n FROM above GROUP BY d, prefix
  HAVING sum(n_bytes) <= {limit} OR min(h) = max(h) OR d = {BITS}),
leaves AS (SELECT h, min(d) AS d FROM (SELECT DISTINCT h, d, prefix FROM above) JOIN nodes USING (d, prefix) GROUP BY h)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(CAST(CAST(h >> ({BITS} - d) AS BIT) AS VARCHAR), 64, '0'), d) END AS shard,
       CAST(d AS INTEGER) AS depth, CAST(bytes AS BIGINT) AS shard_bytes, n AS shard_rows
FROM hashed JOIN leaves USING (h) JOIN nodes USING (d) WHERE prefix = h >> ({BITS} - d)"""
