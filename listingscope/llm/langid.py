"""Language of a text: the language whose raw-content dictionary makes zstandard's encoding smallest.

A dictionary is a bounded sample of the language: SAMPLE excerpts of EXCERPT characters, each from a place in its document that a hash
chooses. A text is encoded in pieces that keep the dictionary inside the window, whole, once per language; the sizes are summed. Where the two
smallest sizes are within NARROW of each other, a slower search (``_THOROUGH``) that finds matches of three bytes decides. A text whose margin
is still narrow, or that has no letter, is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb

SAMPLE, EXCERPT = 200, 300   # labelled documents per language, and characters of each: the bound of the model
MOST_LANGUAGES = 512
PIECE = 1 << 16
NARROW = 0.02                # of the smallest size: encoded again
REJECT = 0.002               # of the smallest size: rejected
UNKNOWN = "und"
_FORMAT = {"window_log": 17, "hash_log": 15, "chain_log": 16, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
_FAST = _FORMAT | {"search_log": 5, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY}
_THOROUGH = _FORMAT | {"search_log": 6, "min_match": 3, "strategy": zstandard.STRATEGY_BTLAZY2}
_LETTER = re.compile(r"[^\W\d_]")


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary per language of the labelled rows; rows without text or label teach nothing.

    The sample is chosen by a hash of the text, so it does not depend on ids or order, and its expected size does not depend on the table. Its rate
    counts different texts, so copies thin it out nowhere. A labelled language that gets no excerpt is an error.
    """
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    different = known.select("l", F.xxhash64("t").alias("h")).distinct()
    counts = {r.l: r.n for r in different.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    drawn = F.pmod(F.xxhash64("t"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.coalesce(*(F.when(F.col("l") == name, F.lit(min(1.0, 1.5 * SAMPLE / n))) for name, n in sorted(counts.items())))
    start = F.pmod(F.xxhash64("t", F.lit(1)), F.greatest(F.lit(1), F.length("t") - EXCERPT)).cast("int") + 1
    chosen = known.withColumn("u", drawn).where(F.col("u") < rate).select("l", "u", F.substring("t", start, F.lit(EXCERPT)).alias("e")).distinct()
    by_lang: dict[str, list] = {}
    for row in chosen.collect():  # about 1.5 * SAMPLE excerpts a language
        by_lang.setdefault(row.l, []).append((row.u, row.e))
    if missing := sorted(counts.keys() - by_lang.keys()):
        raise ValueError(f"no excerpt was drawn for {', '.join(missing)}")
    return {name: "\n".join(e.lower() for _, e in sorted(own)[:SAMPLE]).encode() for name, own in sorted(by_lang.items())}


class Coder:
    """Encoded sizes of a text under each language's dictionary."""

    def __init__(self, dicts: dict[str, bytes]):
        self.names = list(dicts)
        self.fast, self.thorough = ([_compressor(dicts[n], how) for n in self.names] for how in (_FAST, _THOROUGH))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, confidence, rejected)."""
        if not self.names or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8", "replace")
        sizes = _sizes(self.fast, data)
        if _margin(sizes) < NARROW:
            sizes = _sizes(self.thorough, data)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        weight = sum(math.exp(max(-50.0, (sizes[best] - s) / 4.0)) for s in sizes)
        return self.names[best], 1.0 / weight, _margin(sizes) < REJECT


def _compressor(content: bytes, how: dict) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(**how)
    content_ = zstandard.ZstdCompressionDict(content or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content_.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=content_, compression_params=parameters)


def _sizes(coders: list[zstandard.ZstdCompressor], data: bytes) -> list[int]:
    return [sum(len(c.compress(data[i:i + PIECE])) for i in range(0, len(data), PIECE)) for c in coders]


def _margin(sizes: list[int]) -> float:
    if len(sizes) < 2:
        return 1.0
    first, second = sorted(sizes)[:2]
    return (second - first) / first


def identify(docs: DataFrame, dicts: dict[str, bytes], text: str = "text") -> DataFrame:
    """All columns and rows of docs with lang_pred, score (0 to 1) and rejected.

    A text that is null, empty or without a letter is ``und`` with score 0 and rejected, as all are when no language was learned. A tie goes to
    the language that sorts first and is rejected. Of the columns only ``text`` is read; columns that are named like the three new ones are
    replaced. The dictionaries travel with the tasks: at most 60,000 characters for each of at most 512 languages.
    """
    spark = docs.sparkSession
    wb.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(dicts)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(shared.value)
            lang, score, rejected = zip(*map(coder.judge, batch.column(text).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], schema.names)

    return docs.mapInArrow(run, schema)
