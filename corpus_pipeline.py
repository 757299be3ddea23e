"""Corpus pipeline: language, near duplicates, benchmark passages, source mix, shards.

``run(spark, sf_dir)`` takes ``documents`` through STAGES. Each stage is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingscope.llm import decontaminate, langid, minhash, mixing, queries, sharding
from listingscope.llm.columns import plain
from listingscope.session import cut, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts without letters and those with too narrow a margin go. Dictionaries come from the documents' own labels."""
    dicts = langid.dictionaries(docs.select("text", "lang"))
    docs, names, at = plain(docs)
    return langid.identify(docs, dicts, text=at["text"]).where("not rejected").select(*docs.columns).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows that repeat an id with the same text are one document. Different texts of one id are documents of their own, each linked by its own text
    only; of those in one group the one with the smallest hash stays. Rows without an id stay.
    """
    docs, names, at = plain(docs)
    doc_id, text = at["doc_id"], at["text"]
    marks = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.min(F.xxhash64(text)) < F.max(F.xxhash64(text))).alias("_differ"))
    if marks.where("_differ").limit(1).count():
        stay = _kept_of_repeated(docs, doc_id, text)
    else:
        found = minhash.near_duplicates(docs, words=5, percent=80, key=doc_id, text=text)
        stay = found.where(f"kept and {doc_id} is not null").groupBy(F.col(doc_id).alias("_kept")).agg(
            F.lit(None).cast("bigint").alias("_mark"), F.count(F.lit(1)).alias("_rows"))
    rows = docs.join(stay, (F.col(doc_id) == F.col("_kept")) & F.coalesce(F.xxhash64(text) == F.col("_mark"), F.lit(True)))
    once = rows.where("_rows = 1").select(docs.columns)
    least = F.min(F.struct(text, *(c for c in docs.columns if c != text))).alias("_row")
    repeated = rows.where("_rows > 1").groupBy("_kept", "_mark").agg(least).select(*(F.col(f"_row.{c}").alias(c) for c in docs.columns))
    return once.unionByName(repeated).unionByName(docs.where(F.col(doc_id).isNull())).toDF(*names)


def _kept_of_repeated(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_kept, _mark, _rows): id, text hash and number of rows of every text that stays, where an id may have several texts.

    Links are found between different texts, under their hashes as keys. Texts without words have no links.
    """
    worded = F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    held = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_kept"), F.xxhash64(text).alias("_mark"), worded.alias("_worded")).agg(
        F.count(F.lit(1)).alias("_rows"))
    held = cut(held)
    first = held.where("_worded").groupBy("_mark").agg(F.min(F.struct("_kept", "_rows")).alias("_first"))
    first = cut(first.select("_mark", "_first._kept", "_first._rows"))
    texts = docs.withColumn("_m", F.xxhash64(text)).join(first, (F.col(doc_id) == F.col("_kept")) & (F.col("_m") == F.col("_mark")))
    texts = cut(texts.groupBy("_m").agg(F.min(text).alias("_t")))
    found = minhash.near_duplicates(texts, words=5, percent=80, key="_m", text="_t").select("_m", "component_id")
    least = found.join(first, F.col("_m") == F.col("_mark")).groupBy("component_id").agg(F.min(F.struct("_kept", "_mark", "_rows")).alias("_row"))
    return least.select("_row.*").unionByName(held.where("not _worded").select("_kept", "_mark", "_rows"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a window of 13 benchmark words."""
    docs, names, at = plain(docs)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns), text=at["text"])
    return found.where(~queries.is_contaminated()).select(*docs.columns).toDF(*names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in the sources' target shares, a row for each time a document is taken."""
    return mixing.texts(docs, mixing.mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard that holds it; no shard is above the byte limit."""
    return sharding.shards(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Compression, sketches and seeded draws have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
