"""Benchmark passages inside documents: Wu-Manber search over words.

The patterns are the windows of the benchmark: WINDOW consecutive words of an item, or all words of a shorter one. Words are the alphabet, as
64-bit hashes, and a block is two neighbouring words. For patterns of one length m, ``shift[block]`` tells how far the search may jump when it
reads that block at its cursor; an unknown block lets it jump m - 1 words. Where the shift is 0 the block's bucket names the patterns that end
with it; those whose word hashes agree are compared byte by byte. Each length that occurs has tables of its own, so a short item does not
shorten the jumps of the others. All cursors of a batch (one per STRETCH words) move in step as NumPy arrays.

The documents are never shuffled. The benchmark is read in parts of bounded size; each part is one pass over the documents and the only thing
broadcast, so a benchmark of any size is searched with bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb

WINDOW = 13
STRETCH = 512
PART_WORDS = 2_000_000   # words of benchmark text in one broadcast: at most about 200 MB of tables, for 80,000 long items


def _blocks(hashed: np.ndarray) -> np.ndarray:
    """The block that ends at each word; a first word makes a block of its own with nothing before it."""
    before = np.concatenate((np.zeros(1, np.uint64), hashed[:-1]))
    with np.errstate(over="ignore"):
        return wb.mix(hashed * np.uint64(3) + before)


class WuManber:
    """Patterns of one length m: rows of word hashes, their words joined by blanks, and the items that hold them."""

    def __init__(self, rows: np.ndarray, texts: list[bytes], items: list[list[int]]):
        m = rows.shape[1]
        blocks = np.stack([_blocks(r) for r in rows]) if m > 1 else wb.mix(rows)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.m, self.rows, self.ends = m, rows[order], blocks[order, -1]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]
        bits = max(12, int(blocks.size).bit_length() + 3)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, max(1, m - 1), np.int32)
        first = 1 if m > 1 else 0
        jumps = np.broadcast_to(m - 1 - np.arange(first, m), (len(rows), m - first))
        np.minimum.at(self.shift, (blocks[:, first:] & self.mask).astype(np.int64).ravel(), jumps.ravel().astype(np.int32))

    def occurrences(self, w: wb.Words, hashed: np.ndarray) -> Iterator[tuple[int, int]]:
        """(index of the first word, pattern) of every occurrence."""
        m = self.m
        blocks = _blocks(hashed) if m > 1 else wb.mix(hashed)
        begin, end = w.first[:-1] + m - 1, w.first[1:]
        pieces = np.maximum(0, -(-(end - begin) // STRETCH))
        cursor = np.repeat(begin, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        last = np.minimum(cursor + STRETCH, np.repeat(end, pieces))
        stops = []
        while len(cursor):
            jump = self.shift[(blocks[cursor] & self.mask).astype(np.int64)]
            stops.append(cursor[jump == 0])
            cursor = cursor + np.maximum(jump, 1)
            open_ = cursor < last
            cursor, last = cursor[open_], last[open_]
        at = np.concatenate(stops) if stops else np.empty(0, np.int64)
        low, high = np.searchsorted(self.ends, blocks[at], "left"), np.searchsorted(self.ends, blocks[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        checked: dict[tuple[int, bytes], bool] = {}
        while len(at):  # one pattern of each bucket at a time
            same = np.ones(len(at), bool)
            for j in range(m):
                same[same] = hashed[at[same] - m + 1 + j] == self.rows[low[same], j]
            for e, p in zip(at[same].tolist(), low[same].tolist()):
                s = e - m + 1
                seen = (p, w.data[w.starts[s]:w.ends[e]].tobytes())
                if seen not in checked:
                    checked[seen] = b" ".join(w.data[w.starts[i]:w.ends[i]].tobytes() for i in range(s, e + 1)) == self.texts[p]
                if checked[seen]:
                    yield s, p
            low = low + 1
            at, low, high = at[low < high], low[low < high], high[low < high]


def tables(texts: list[str], window: int) -> list[WuManber]:
    """Search tables of all windows of the texts; items are numbered by their place."""
    w = wb.words(pa.array(texts, pa.string()), wb.ALPHANUMERIC)
    hashed = wb.hashes(w.data, w.starts, w.ends)
    found: dict[bytes, tuple[np.ndarray, list[int]]] = {}
    for item, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        own = [w.data[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b])]
        m = min(window, len(own))
        for i in range(len(own) - m + 1 if own else 0):
            _, items = found.setdefault(b" ".join(own[i:i + m]), (hashed[a + i:a + i + m], []))
            if not items or items[-1] != item:
                items.append(item)
    by_length: dict[int, list[bytes]] = {}
    for text, (row, _) in found.items():
        by_length.setdefault(len(row), []).append(text)
    return [WuManber(np.stack([found[t][0] for t in group]), group, [found[t][1] for t in group]) for _, group in sorted(by_length.items())]


def _parts(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Items in parts of at most PART_WORDS words (or one item)."""
    ids, texts, n = [], [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(item, text).toLocalIterator():
        size = len(row[1]) // 2 + 1
        if ids and n + size > PART_WORDS:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        n += size
    if ids:
        yield ids, texts


FOUND = ("n_words", "n_hit", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns ``keep`` and n_words, n_hit, spans, items for every row of docs; a kept column with one of these names is left out.

    ``spans`` are the runs of hit words (first word, number of words), ``items`` the benchmark items with an occurring window, ascending and
    each once. A null or wordless text has no words and no hits; a benchmark row without text or words has no window; one without an id marks
    words and is not named. Equal items share their windows and are all named. Equal documents get equal rows. Columns that are not kept are not
    read. An empty benchmark hits nothing. Rows are not joined to anything, so keeping their columns costs no shuffle.
    """
    spark = docs.sparkSession
    wb.bounded_batches(spark)
    item_kind = benchmark.schema[item].dataType
    kept = [c for c in keep if c not in FOUND]
    carried = [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType())]))
    schema = T.StructType([
        *carried, T.StructField("t", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(item_kind))])

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, search = shared.value
            for batch in batches:
                for part in wb.slices(batch, "t"):
                    yield _marked(part, ids, search)
        return run

    rows = docs.select(
        *(F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)), F.col(text).alias("t"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"),
        F.array().cast(span).alias("spans"), F.array().cast(T.ArrayType(item_kind)).alias("items"))
    passes = 0
    for ids, texts in _parts(benchmark, item, item_text):
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast((ids, tables(texts, window)))), schema)
        passes += 1
    if not passes:
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(([], []))), schema)
    items = F.array_sort(F.array_distinct("items"))
    return rows.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)), "n_words", "n_hit", "spans", items.alias("items"))


def _marked(part: pa.RecordBatch, ids: list, search: list[WuManber]) -> pa.RecordBatch:
    w = wb.words(part.column("t"), wb.ALPHANUMERIC)
    hashed = wb.hashes(w.data, w.starts, w.ends)
    n, total = part.num_rows, len(hashed)
    edge = np.zeros(total + 1, np.int64)
    items = part.column("items").to_pylist()
    seen: list[set] = [set() for _ in range(n)]
    for table in search:
        for s, p in table.occurrences(w, hashed):
            edge[s] += 1
            edge[s + table.m] -= 1
            seen[int(np.searchsorted(w.first, s, "right")) - 1].update(table.items[p])
    hit = np.cumsum(edge[:-1]) > 0
    for d, before in enumerate(part.column("spans").to_pylist()):
        for old in before:
            hit[w.first[d] + old["first"]:w.first[d] + old["first"] + old["words"]] = True
        items[d] = items[d] + [ids[i] for i in seen[d] if ids[i] is not None]
    counts = np.diff(np.concatenate(([0], np.cumsum(hit)))[w.first])
    spans = []
    for d in range(n):
        own = np.concatenate(([False], hit[w.first[d]:w.first[d + 1]], [False])) if counts[d] else np.zeros(1, bool)
        turns = np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)
        spans.append([{"first": int(a), "words": int(b - a)} for a, b in turns])
    return pa.RecordBatch.from_arrays(
        [*(part.column(c) for c in part.schema.names if c not in FOUND), pa.array(np.diff(w.first)), pa.array(counts),
         pa.array(spans, part.schema.field("spans").type), pa.array(items, part.schema.field("items").type)], part.schema.names)
