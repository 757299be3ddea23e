"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are all runs of WIDTH words that begin at a multiple of HOP; templates are cut into clauses of at most HOP words, so a clause that a text holds lies
whole in a block. A clause is found in a block that holds at least ``percent`` of its distinct words. Words are ordered by their number in all
documents, rarest first, and every pair that meets the threshold passes these filters:

* prefix: a clause of t words that needs o of them shares one of its first t - o + 1 words with the block;
* length: the block has at least o words that any clause knows;
* position: the first word they share is followed, in the clause and in the block, by enough words to make o.

What is left is compared word by word. Phrases are clauses that need all their words; in their blocks the places where the words stand consecutively
are listed, each in the block whose first HOP words hold its start.

Clauses are dealt into parts of about PART; each part is broadcast (a few MB) for one pass over the texts, so a task holds one part at a time whatever
the number of templates. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb
from listingscope.session import cut

WIDTH, HOP = 64, 32
PART = 20_000
LONG_ENOUGH = 8       # a clause cut off a template has at least so many words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases whose places are listed.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: (label, percent of the distinct words, text): notices and sentences by which licenses are known.
TEMPLATES = (
    ("mit", 80, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
                "Software without restriction"),
    ("mit", 80, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", 80, "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", 80, "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", 80, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                "Software Foundation"),
    ("gpl", 100, "licensed under the GPL version"),
    ("lgpl", 80, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                 "the Free Software Foundation"),
    ("agpl", 80, "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", 80, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", 80, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", 80, "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", 80, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", 80, "This is free and unencumbered software released into the public domain"),
    ("epl", 80, "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("warranty-disclaimer", 80, "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                                "MERCHANTABILITY"),
    ("cc-by", 100, "licensed under cc by 4 0"),
    ("cc-by", 80, "This work is licensed under a Creative Commons Attribution International License"),
    ("cc-by-sa", 100, "licensed under cc by sa 4 0"),
    ("cc-by-sa", 90, "This work is licensed under a Creative Commons Attribution ShareAlike International License"),
    ("cc-by-nc", 100, "licensed under cc by nc 4 0"),
    ("cc-by-nc", 90, "This work is licensed under a Creative Commons Attribution NonCommercial International License"),
    ("all-rights-reserved", 100, "copyright all rights reserved"),
)


def known_templates(spark: SparkSession) -> DataFrame:
    """(label, text, percent, phrase): TEMPLATES and PHRASES."""
    rows = [(label, text, percent, False) for label, percent, text in TEMPLATES] + [(label, text, 100, True) for label, text in PHRASES]
    return spark.createDataFrame(rows, "label string, text string, percent int, phrase boolean")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), 1)


def clauses(templates: DataFrame) -> DataFrame:
    """(label, percent, phrase, words): templates cut into even pieces of at most HOP words; a phrase must not be longer than HOP.

    Templates without a label, a percentage from 1 to 100, or words find nothing and are left out; equal ones count once.
    """
    known = templates.where("label is not null and percent between 1 and 100").select(
        "label", "percent", F.coalesce("phrase", F.lit(False)).alias("phrase"), _words(F.col("text")).alias("all"))
    n = F.size("all")
    known = known.withColumn("phrase", F.when(F.col("phrase") & (n > HOP), F.raise_error(F.lit(f"a phrase has more than {HOP} words"))).otherwise(F.col("phrase")))
    pieces = F.ceil(n / HOP)
    return known.where(n > 0).select(
        "label", "percent", "phrase", F.explode(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.slice(
            "all", (F.floor(i * n / pieces) + 1).cast("int"), (F.floor((i + 1) * n / pieces) - F.floor(i * n / pieces)).cast("int")))).alias("words")).distinct()


@dataclass
class Clause:
    label: str
    percent: int
    phrase: bool
    words: list[bytes]
    ranks: np.ndarray = field(default=None)       # distinct words in the global order
    needed: int = 0
    in_order: list[int] = field(default=None)     # of a phrase: its words, by rank


class Index:
    """Clauses under the words of their prefixes."""

    def __init__(self, known: list[Clause], counts: dict[bytes, int]):
        order = sorted(counts, key=lambda w: (counts[w], w))
        self.spelled = order
        hashed = _hashes(order)
        place = np.argsort(hashed, kind="stable")
        self.hashes, self.rank_at = hashed[place], place.astype(np.int32)
        rank = {w: i for i, w in enumerate(order)}
        self.clauses, self.postings = known, {}
        for c, clause in enumerate(known):
            clause.ranks = np.array(sorted({rank[w] for w in clause.words}), np.int32)
            clause.needed = -(-clause.percent * len(clause.ranks) // 100)
            clause.in_order = [rank[w] for w in clause.words]
            for i in range(len(clause.ranks) - clause.needed + 1):
                self.postings.setdefault(int(clause.ranks[i]), []).append((c, i))
        self.in_prefix = np.zeros(len(order) + 1, bool)     # the last entry stands for rank -1
        self.in_prefix[list(self.postings)] = True
        self.fewest = min((c.needed for c in known), default=1)

    def ranks(self, w: wb.Words) -> np.ndarray:
        """Rank of each word, -1 for words of no clause."""
        if not len(self.hashes) or not len(w.starts):
            return np.full(len(w.starts), -1, np.int32)
        hashed = wb.hashes(w.data, w.starts, w.ends)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, self.rank_at[at], np.int32(-1))

    def meets(self, tokens: list[int]) -> list[tuple[Clause, int]]:
        """Clauses of which a block with these distinct ranks, ascending, holds enough words, and how many."""
        size, seen, out = len(tokens), set(), []
        block = np.array(tokens, np.int32)
        for j, t in enumerate(tokens):
            if size - j < self.fewest:
                break
            for c, i in self.postings.get(t, ()):
                if c in seen:
                    continue
                seen.add(c)      # t is the first word they share
                clause = self.clauses[c]
                if size < clause.needed or 1 + min(len(clause.ranks) - i - 1, size - j - 1) < clause.needed:
                    continue
                shared = int(np.isin(clause.ranks[i:], block[j:], assume_unique=True).sum())
                if shared >= clause.needed:
                    out.append((clause, shared))
        return out


def _hashes(words: list[bytes]) -> np.ndarray:
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    return wb.hashes(np.frombuffer(b" ".join(words), np.uint8), ends - lengths, ends) if words else np.empty(0, np.uint64)


def _counted(texts: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How often each of the words stands in all texts (t)."""
    hashed = _hashes(words)
    place = np.argsort(hashed, kind="stable")
    shared = texts.sparkSession.sparkContext.broadcast(hashed[place])   # the words of one part

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in wb.slices(batch, "t"):
                w = wb.words(part.column("t"), wb.ALPHANUMERIC)
                if len(w.starts):
                    own = wb.hashes(w.data, w.starts, w.ends)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    total += np.bincount(at[known[at] == own], minlength=len(known))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["at", "n"])

    out = dict.fromkeys(words, 0)
    for r in texts.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row per word of the part
        out[words[place[r.at]]] = r.n
    return out


_PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType())])
_FOUND = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType()), T.StructField("share", T.DoubleType())])


def _scan_text(index: Index, w: wb.Words, ranks: np.ndarray, a: int, b: int) -> tuple[list[dict], list[dict]]:
    """Places and blocks of the text whose words are a:b."""
    at = np.flatnonzero(index.in_prefix[ranks[a:b]]) // HOP
    places, blocks = [], []
    for k in np.union1d(at, at[at > 0] - 1).tolist():     # a word lies in the block that begins in its hop and in the one before
        first, end = a + k * HOP, min(b, a + k * HOP + WIDTH)
        own = ranks[first:end].tolist()
        for p, t in enumerate(own):     # equal hashes are no proof
            if t >= 0 and w.data[w.starts[first + p]:w.ends[first + p]].tobytes() != index.spelled[t]:
                own[p] = -1
        for clause, shared in index.meets(sorted({t for t in own if t >= 0})):
            if not clause.phrase:
                blocks.append({"label": clause.label, "first": k * HOP, "words": end - first, "share": shared / len(clause.ranks)})
                continue
            n = len(clause.in_order)
            places += [{"label": clause.label, "first": k * HOP + p} for p in range(min(HOP, len(own) - n + 1)) if own[p:p + n] == clause.in_order]
    return places, blocks


def _pass(docs: DataFrame, index: Index) -> DataFrame:
    """(id, t, n_words, places, blocks) of every row (id, t)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)   # one part
    schema = T.StructType([docs.schema["id"], T.StructField("h", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("places", T.ArrayType(_PLACE)), T.StructField("blocks", T.ArrayType(_FOUND))])
    kinds = [pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())])),
             pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in wb.slices(batch, "t"):
                w = wb.words(part.column("t"), wb.ALPHANUMERIC)
                ranks = known.ranks(w)
                found = [_scan_text(known, w, ranks, a, b) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("h"), pa.array(np.diff(w.first)), *(pa.array([x[i] for x in found], kinds[i]) for i in (0, 1))], schema.names)

    return docs.select("id", "h", "t").mapInArrow(run, schema)


def scan(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """(key, n_words, places, blocks) of every row.

    ``places``: (label, first word) of every place of a phrase. ``blocks``: (label, first word, words, share of the clause's distinct words) of every
    block and clause that meets its threshold. ``templates`` is (label, text, percent, phrase), by default those known here; see ``clauses``.

    Null and empty texts have no words, places or blocks. Rows are judged by their own text, so repeated rows and keys and a null key are rows like
    others. A very long text is read whole, in a slice of its own. Other columns are not read. No templates find nothing; an empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    wb.bounded_batches(spark)
    known = cut(clauses(known_templates(spark) if templates is None else templates))
    parts = max(1, -(-known.count() // part))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    deal = F.pmod(F.xxhash64("label", "percent", "phrase", "words"), F.lit(parts))
    passes = []
    for p in range(parts):
        own = [Clause(r.label, r.percent, r.phrase, [w.encode() for w in r.words]) for r in known.where(deal == p).toLocalIterator()]   # about ``part``
        own.sort(key=lambda c: (c.label, c.percent, c.words, c.phrase))
        vocabulary = sorted({w for c in own for w in c.words})
        passes.append(_pass(rows, Index(own, _counted(rows, vocabulary) if vocabulary else {})))
    out = passes[0]
    if parts > 1:
        more = passes[0].limit(0).select("id", "h", "places", "blocks", F.lit(0).alias("p"))
        for p, found in enumerate(passes[1:], 1):
            more = more.unionByName(found.where("size(places) + size(blocks) > 0").select("id", "h", "places", "blocks", F.lit(p).alias("p")))
        # Rows of one key with one text have the same finds.
        more = more.dropDuplicates(["id", "h", "p"]).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(
            F.flatten(F.collect_list("places")).alias("_places"), F.flatten(F.collect_list("blocks")).alias("_blocks"))
        more = cut(more)
        both = out.join(more, out["id"].eqNullSafe(more["_id"]) & out["h"].eqNullSafe(more["_h"]), "left")
        out = both.select("id", "n_words", *(F.array_sort(F.concat(c, F.coalesce(f"_{c}", F.expr(f"slice({c}, 1, 0)")))).alias(c) for c in ("places", "blocks")))
    return out.select(F.col("id").alias(key), "n_words", "places", "blocks")


def scan_sql() -> str:
    """The registered query's rows in DuckDB: every block against every clause."""
    lower = f"translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}')"
    pieces = []
    for label, percent, text in TEMPLATES:
        words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        cuts = -(-len(words) // HOP)
        pieces += [(label, percent, words[i * len(words) // cuts:(i + 1) * len(words) // cuts]) for i in range(cuts)]
    table = " UNION ALL ".join(f"SELECT '{label}' AS label, {percent} AS percent, {sorted(set(words))} AS words" for label, percent, words in pieces)
    phrases = " UNION ALL ".join(f"SELECT '{label}' AS label, {text.split()} AS words" for label, text in PHRASES)
    return f"""
WITH clauses AS ({table}), phrases AS ({phrases}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower.format('text')}, '{WORD}') AS w FROM documents),
spots AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
places AS (SELECT r, label, i - 1 AS first FROM spots JOIN phrases p ON w[i] = p.words[1] AND w[i:i + len(p.words) - 1] = p.words),
blocks AS (SELECT r, list_distinct(w[k + 1:k + {WIDTH}]) AS held FROM (SELECT r, w, unnest(range(0, len(w), {HOP})) AS k FROM docs)),
met AS (SELECT r, label, len(list_intersect(held, words)) AS shared, len(words) AS size, percent FROM blocks, clauses),
found AS (SELECT r, label, max(shared / size) AS share FROM met WHERE shared * 100 >= percent * size GROUP BY r, label),
base AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM places GROUP BY r),
named AS (SELECT r, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
         FROM (SELECT r, label, share FROM found UNION ALL SELECT r, label, 1.0 FROM places) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN named USING (r)"""
