"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of BLOCK words; the last block is what remains. A source's target is
its weight's share of all words, but at most MOST_PASSES times its own words; what is above is shared among the others by weight. The mix is a
row of slots, one block each, cut into output shards of SHARD slots. Every shard draws how many slots each source gets from a multinomial
distribution over the targets; slots of sources that drew more than their target in all are then given to those that drew less, so the totals
are exact. The slots of a source go through its blocks in passes, each pass in the order of a pseudorandom permutation of the block indices, and
are joined with the blocks by index. The last slot of a source may take only the first words of its block.

Everything that grows with the data (offsets, slots, blocks) is dealt by source and hashed bucket, shard or block index, never by source alone;
only the source totals, one row each, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb
from listingscope.llm.columns import plain
from listingscope.session import cut

BLOCK, SHARD, MOST_PASSES = 128, 8192, 3
BUCKETS, BUCKET_ROWS = 256, 50_000
MOST_SOURCES = 1_000_000
SEED = 20240229


def n_words(text: str = "text"):
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Shares of all words by weight; no target is above ``most`` times its size, the excess is shared again by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / weight
        above = {i for i in open_ if out[i] > most * sizes[i]}
        for i in above:
            out[i] = float(most * sizes[i])
        if not above:
            break
        open_ -= above
    return out


def cycled_weights(n: int, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> list[float]:
    return [cycle[i % len(cycle)] for i in range(n)]


def permuted(index: np.ndarray, n: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each salt: four Feistel rounds on the next even number of bits, walked back into the range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        keys = [wb.mix(salt.astype(np.uint64) + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) for r in range(4)]
        while len(todo):
            x, h, m = out[todo], half[todo], mask[todo]
            a, b = x >> h, x & m
            for key in keys:
                a, b = b, a ^ (wb.mix(b + key[todo]) & m)
            out[todo] = (a << h) | b
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _plan(spark, rows: DataFrame, weights, block: int) -> tuple[DataFrame, list, int]:
    """A row per source: its number, words, target, blocks, slots and the words of its last pass."""
    known = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(known) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    known.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.words for r in known], weights(len(known)))
    plan = []
    for i, (r, t) in enumerate(zip(known, goal)):
        blocks = -(-r.words // block)
        whole = min(MOST_PASSES, int(t // r.words)) if r.words else 0
        rest = min(round(t) - whole * r.words, r.words) if r.words else 0
        short = blocks * block - r.words
        # The short last block may be among the slots of the last pass.
        extra = min(blocks, -(-(rest + short) // block)) if rest > 0 else 0
        plan.append((i, r.source, r.words, t, blocks, whole, max(0, rest), whole * blocks + extra))
    schema = "s int, source string, source_size long, target double, blocks long, whole long, rest long, slots long"
    return spark.createDataFrame(plan, schema), plan, sum(r.docs for r in known)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=cycled_weights, block: int = BLOCK,
        seed: int = SEED) -> DataFrame:
    """(key, size, source, source_size, target, taken, pieces, _t, _start) for every row of docs.

    ``size`` is the number of words, ``taken`` how many words of the row the mix holds, repeats counted: at most MOST_PASSES times its size.
    ``pieces`` lists stretches of the row (first word, words, copies); words outside them are not taken. ``_t``, a hash of the text,
    and ``_start``, the place in the source, tell rows of one key apart. ``weights`` gives a weight for each of n sources, in code point order, null last (a null source is a
    source). Null and empty texts have size 0 and nothing is taken. Equal rows are mixed each by itself. The result depends on the rows, the
    weights, the block length and the seed, not on partitions. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    wb.bounded_batches(spark)
    rows = cut(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("_t")))
    plan, sources, n = _plan(spark, rows, weights, block)
    buckets = BUCKETS * max(1, n // (BUCKETS * BUCKET_ROWS))
    known = plan.select("s", F.col("source").alias("_source"), "source_size", "target")   # at most MOST_SOURCES rows; Spark broadcasts by size
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "_t", F.lit(seed)), F.lit(buckets)))
    inside = Window.partitionBy("s", "bucket").orderBy("_t", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("b")).withColumn("before", F.sum("b").over(across) - F.col("b")).drop("b")
    placed = cut(placed.withColumn("upto", F.sum("size").over(inside)).join(sums, ["s", "bucket"]).withColumn(
        "start", F.col("before") + F.col("upto") - F.col("size")).drop("bucket", "before", "upto"))

    pieces = placed.where("size > 0").select("s", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("index"))
    used = _slots(spark, plan, sources, block, seed)
    low = F.greatest(F.col("start"), F.col("index") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block)
    part_end = F.least(F.col("index") * block + F.col("part"), high)
    joined = pieces.join(used, ["s", "index"]).select(
        "s", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"), "copies", F.greatest(F.lit(0), part_end - low).alias("more"))
    stretch = F.array(
        F.struct("first", "words", "copies"), F.struct(F.col("first"), F.col("more").alias("words"), F.lit(1).cast("bigint").alias("copies")))
    taken = joined.groupBy("s", "start").agg(
        F.sum(F.col("words") * F.col("copies") + F.col("more")).alias("taken"),
        F.array_sort(F.filter(F.flatten(F.collect_list(stretch)), lambda p: (p["words"] > 0) & (p["copies"] > 0))).alias("pieces"))
    full = placed.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    out = full.join(taken.withColumnRenamed("start", "at"), ["s", "at"], "left")
    return out.select(
        F.col("id").alias(key), "size", F.col("source").alias(source), "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "pieces", "_t", F.col("start").alias("_start"))


def _slots(spark, plan: DataFrame, sources: list, block: int, seed: int) -> DataFrame:
    """(s, index, copies, part): how often each block is taken whole, and how many first words of it once more."""
    slots = np.array([p[7] for p in sources], np.int64)
    total = int(slots.sum())
    empty = "s int, index long, copies long, part long"
    if not total:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(slots / total)   # a number per source, of which there are at most MOST_SOURCES
    shards = -(-total // SHARD)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                room = min(SHARD, total - shard * SHARD)
                counts = np.random.default_rng([seed, shard]).multinomial(room, shared.value)
                s = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), shard)), pa.array(s.astype(np.int32)), pa.array(counts[s].astype(np.int64))], ["shard", "s", "n"])

    drawn = cut(spark.range(shards).mapInArrow(draw, "shard long, s int, n long"))
    upto = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = drawn.withColumn("from", F.sum("n").over(upto) - F.col("n"))
    got = {r.s: r.n for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    # What a source drew above its slots, in source order, is given to those that drew less.
    over, under, surplus, lack = [], [], 0, 0
    for p in sources:
        d = got.get(p[0], 0) - p[7]
        over.append((p[0], p[7], surplus))
        surplus += max(0, d)
        if d < 0:
            under.append((p[0], p[7] + d, lack, -d))
            lack -= d
    over_df = spark.createDataFrame(over, "s int, quota long, base long")
    each = runs.join(F.broadcast(over_df), "s").select("shard", "s", "quota", "base", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("j"))
    kept = each.where("j < quota").select("shard", "s", "j")
    given = each.where("j >= quota").select("shard", (F.col("base") + F.col("j") - F.col("quota")).alias("u"))
    if under:
        lacking = spark.createDataFrame(under, "s int, has long, base long, n long").select(
            "s", F.posexplode(F.expr("sequence(has, has + n - 1)")).alias("k", "j"), "base").select("s", "j", (F.col("base") + F.col("k")).alias("u"))
        kept = kept.unionByName(given.join(lacking, "u").select("shard", "s", "j"))
    known = kept.join(F.broadcast(plan.select("s", "blocks", "whole", "rest", "source_size")), "s")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j, n, s = (batch.column(c).to_numpy() for c in ("j", "blocks", "s"))
            turn = j // np.maximum(n, 1)
            with np.errstate(over="ignore"):
                salt = wb.mix(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn.astype(np.uint64) + np.uint64(seed))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("s"), pa.array(permuted(j % np.maximum(n, 1), n, salt)), pa.array(turn), pa.array(j % np.maximum(n, 1)),
                 batch.column("blocks"), batch.column("whole"), batch.column("rest"), batch.column("source_size")],
                ["shard", "s", "index", "turn", "place", "blocks", "whole", "rest", "source_size"])

    slot = cut(known.select("shard", "s", "j", "blocks", "whole", "rest", "source_size").mapInArrow(
        place, "shard long, s int, index long, turn long, place long, blocks long, whole long, rest long, source_size long"))
    # Where the short block stands in the last pass: the slots after it begin that much earlier.
    last = F.col("turn") == F.col("whole")
    short = slot.where(last & (F.col("index") == F.col("blocks") - 1)).select("s", F.col("place").alias("short_at"))
    out = slot.join(short, "s", "left")
    lost = F.col("blocks") * block - F.col("source_size")
    begin = F.col("place") * block - F.when(F.col("place") > F.col("short_at"), lost).otherwise(0)
    length = F.when(F.col("index") == F.col("blocks") - 1, block - lost).otherwise(block)
    words = F.when(last, F.greatest(F.lit(0), F.least(length, F.col("rest") - begin))).otherwise(length)
    out = out.withColumn("take", words).withColumn("length", length)
    return out.groupBy("s", "index").agg(
        F.sum(F.when(F.col("take") == F.col("length"), 1).otherwise(0)).cast("bigint").alias("copies"),
        F.sum(F.when(F.col("take") < F.col("length"), F.col("take")).otherwise(0)).cast("bigint").alias("part"))


def texts(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars") -> DataFrame:
    """The mix at document grain, with the columns of docs: a row for each time a document is taken, at most MOST_PASSES.

    The c-th row of a document holds its words that are taken c times or more, in order, with the white space between neighbouring words; a
    document that is taken whole keeps its text. Documents that are not taken have no row. Equal rows are taken each by itself. ``n_chars``, if docs has it, is that of the new text.
    """
    wb.bounded_batches(docs.sparkSession)
    right = mixed.withColumn("_n", F.row_number().over(Window.partitionBy(key, source, "_t").orderBy("_start"))).where("taken > 0").select(
        F.col(key).alias("_k"), F.col(source).alias("_s"), F.col("_t").alias("_h"), F.col("_n").alias("_m"), F.col("pieces").alias("_pieces"))
    docs, names, at = plain(docs)
    key, text, source, n_chars = at[key], at[text], at[source], at.get(n_chars)
    left = docs.withColumn("_t", F.xxhash64(text)).withColumn("_n", F.row_number().over(Window.partitionBy(key, source, "_t").orderBy(*docs.columns)))
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col(source).cast("string").eqNullSafe(F.col("_s")) & (F.col("_t") == F.col("_h")) & (F.col("_n") == F.col("_m"))
    rows = left.join(right, same)
    schema = docs.schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, made = [], []
            for i, (t, own) in enumerate(zip(batch.column(text).to_pylist(), batch.column("_pieces").to_pylist())):
                for new in _copies(t, own):
                    places.append(i)
                    made.append(new)
            taken = batch.select(schema.names).take(pa.array(places, pa.int64()))
            columns = [pa.array(made, pa.string()) if n == text else pa.array([len(m) for m in made], pa.int64()).cast(taken.column(n).type) if n == n_chars else taken.column(n)
                       for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select(*docs.columns, "_pieces").mapInArrow(build, schema).toDF(*names)


def _copies(text: str, pieces: list[dict]) -> list[str]:
    w = wb.words(pa.array([text], pa.string()), wb.BLANK_SEPARATED)
    raw = text.encode()
    n = len(w.starts)
    copies = np.zeros(n, np.int64)
    for p in pieces:
        copies[p["first"]:p["first"] + p["words"]] += p["copies"]
    out = []
    for c in range(1, int(copies.max(initial=0)) + 1):
        has = copies >= c
        if has.all():
            out.append(text)
            continue
        turns = np.flatnonzero(np.diff(np.concatenate(([False], has, [False])).astype(np.int8))).reshape(-1, 2)
        out.append(" ".join(raw[w.starts[a]:w.ends[b - 1]].decode() for a, b in turns))
    return out
