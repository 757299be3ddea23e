"""Occurrences of many keywords in texts, in one pass whatever the number of words.

The words come as a table. An automaton with failure links reads each text once and tells every place where a word ends; of the places of one word
those that do not overlap count, from the left, as in counting a substring. Words are dealt by hash into parts of about PART; each part is broadcast
(a few MB) and read in a pass of its own, so a table of any length is searched with bounded memory.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from listingscope.session import cut, small_batches

PART = 50_000


def count_words(automaton: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """{word number: occurrences that do not overlap}"""
    ends: dict[int, int] = {}
    found: dict[int, int] = {}
    for end, (number, length) in automaton.iter(text):
        if end - length >= ends.get(number, -1):
            found[number] = found.get(number, 0) + 1
            ends[number] = end
    return found


def automaton_of(words: Sequence[str]) -> ahocorasick.Automaton | None:
    """None without words."""
    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, (i, len(w)))
    if not words:
        return None
    out.make_automaton()
    return out


def keyword_hits(texts: DataFrame, words: DataFrame, keys: Sequence[str], text: str = "text", part: int = PART) -> DataFrame:
    """(keys, list, hits): how often the words (word, list) of each list stand in the texts of each key, where they stand at all.

    Texts are lower-cased and words are not. A word may be in several lists; equal rows of ``words`` count once, null and empty words are left out.
    Rows of one key add up. Null and empty texts hold nothing.
    """
    spark = texts.sparkSession
    small_batches(spark)
    known = words.where("word is not null and word <> ''").groupBy("word").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    known = cut(known)
    parts = max(1, -(-known.count() // part))
    kind = words.schema["list"].dataType
    schema = T.StructType([*(texts.schema[k] for k in keys), T.StructField("list", kind), T.StructField("hits", T.LongType())])
    list_type = to_arrow_type(kind)
    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.lower(text).alias("_text"))

    def search(p: int) -> DataFrame:
        own = [(r.word, list(r.lists)) for r in known.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == p).orderBy("word").toLocalIterator()]   # about ``part``
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = [x for _, x in shared.value]
            automaton = automaton_of([w for w, _ in shared.value])
            for batch in batches if automaton else ():
                at, names, hits = [], [], []
                for i, t in enumerate(batch.column("_text").to_pylist()):
                    sums: dict = {}
                    for number, n in count_words(automaton, t).items():
                        for name in lists[number]:
                            sums[name] = sums.get(name, 0) + n
                    at += [i] * len(sums)
                    names += sums.keys()
                    hits += sums.values()
                taken = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(taken.column(k) for k in keys), pa.array(names, list_type), pa.array(hits, pa.int64())], schema.names)

        return rows.mapInArrow(run, schema)

    found = search(0)
    for p in range(1, parts):
        found = found.unionByName(search(p))
    return found.groupBy(*keys, "list").agg(F.sum("hits").alias("hits"))


# Workers get the functions above themselves, so an executor needs Arrow and pyahocorasick but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
