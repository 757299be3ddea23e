"""Mixing, sharding, line templates and exact top-k against plain Python or DuckDB."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from listingscope.llm import line_templates, mixing, sharding, topk
from tests.compare import compare

DOCS = [(1, "a b c", "s"), (2, "d e f g h i j k", "t"), (3, None, "s"), (4, "", None), (5, " x\ty ", None), (6, "l " * 900, "u"), (7, "m n", "s"), (7, "m n", "s"), (None, "o", "t")]


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.targets([1, 100], [3, 1]) == [3, 98]
    assert mixing.targets([0, 0], [1, 1]) == [0, 0] and mixing.targets([], []) == []
    got = mixing.targets([5, 1, 200, 40], [1, 2, 3, 1])
    assert abs(sum(got) - 246) < 1e-9 and all(t <= 3 * s + 1e-9 for t, s in zip(got, [5, 1, 200, 40]))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutations_are_permutations(n):
    index = np.arange(n)
    got = [mixing.permuted(index, np.full(n, n), np.full(n, salt)) for salt in (1, 2)]
    assert all(sorted(g) == list(range(n)) for g in got) and (n < 10 or (got[0] != got[1]).any())


@pytest.mark.parametrize("block", [1, 4, 128])
def test_mix_reaches_its_targets(spark, block):
    df = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, source string, size string")
    one = mixing.mix(df, block=block)
    got = one.toPandas()
    assert sorted(got["size"]) == sorted(len((t or "").split()) for _, t, _ in DOCS)
    assert (got.taken <= 3 * got["size"]).all()
    for _, own in got.groupby(got.source.fillna("-")):
        assert own["size"].sum() == own.source_size.iloc[0] and abs(own.taken.sum() - own.target.iloc[0]) <= 1
    again = mixing.mix(df.repartition(3), block=block)
    key = ["doc_id", "size", "source", "target", "taken"]
    assert sorted(map(str, one.select(key).collect())) == sorted(map(str, again.select(key).collect()))
    texts = mixing.texts(df, one, n_chars=None)
    assert texts.columns == df.columns
    assert texts.select(F.sum(mixing.n_words())).first()[0] == got.taken.sum()
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_texts_hold_the_pieces():
    assert mixing._copies("a  b\tc d", [{"first": 0, "words": 4, "copies": 1}]) == ["a  b\tc d"]
    assert mixing._copies("a  b\tc d e", [{"first": 0, "words": 2, "copies": 2}, {"first": 3, "words": 1, "copies": 1}]) == ["a  b d", "a  b"]


@pytest.mark.parametrize("limit", [1, 40, 1000, 10**9])
def test_shards_against_sql(spark, limit):
    rows = [*DOCS, *((i, "é" * (i % 30), "z") for i in range(100, 180))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, shard string")
    got = sharding.shards(df, limit)
    assert got.count() == len(rows) and got.drop("n_bytes", "shard", "depth", "shard_bytes", "shard_rows").columns == ["doc_id", "text", "source"]
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con.register("documents", documents)
    assert compare(got.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"), con, sharding.shards_sql(limit)) is None
    assert sharding.shards(df.limit(0), limit).count() == 0


def test_cells_that_stay_too_large_are_split_deeper(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINER", 1)
    df = spark.createDataFrame([(i, "x" * (100 if i % 7 == 0 else 1)) for i in range(300)], "doc_id long, text string")
    got = sharding.shards(df, 120)
    assert len(sharding.directory(df.select(F.octet_length("text").cast("long").alias("n_bytes"), sharding.row_hash(F.col("doc_id"), F.col("text")).alias("_h")), 120)) > 1
    assert got.where("shard is null").count() == 0 and got.agg(F.max("shard_bytes")).first()[0] <= 120
    sums = got.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.max("shard_bytes").alias("s"))
    assert sums.where("b <> s").count() == 0


def test_written_shards_are_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(20)], "doc_id long, text string")
    sharding.write(sharding.shards(df, 50), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def lines(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        name, day = r.choice(("Ann", "Bob", "Cy", "Dee")), r.randrange(10**6)
        w = "".join(chr(97 + int(c)) for c in f"{i * i * 7919:07d}")
        text = [f"own {w} of {w[::-1]} text and {w[1:]} here", f"Posted on the page by {name} at noon for all", f"Order {day} shipped"]
        rows.append((i, "\n".join([*text[:1 + i % 3], "", "All rights reserved." if i % 4 == 0 else f"tail {w} of many other {w} x"])))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, rows[5][1]), (n + 3, rows[5][1]), (None, rows[2][1] + "\nend")]


def test_recurring_templates_go(spark):
    df = spark.createDataFrame([(i, t, 3) for i, t in lines(40)], "doc_id long, text string, n_lines int")
    got = line_templates.drop_recurring_lines(df, min_documents=5)
    text = {r.doc_id: r.text for r in got.collect()}
    assert got.count() == 46 and text[40] is None and text[41] == "" and text[42] == "\n\n"
    joined = "\n".join(t for t in text.values() if t)
    assert "Posted on" not in joined and "shipped" not in joined and "reserved" not in joined and joined.count("own ") == 42
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con.register("documents", documents)
    digest = got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    assert compare(digest, con, line_templates.recurring_lines_sql(5)) is None
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0


def test_copies_of_a_document_do_not_empty_it(spark):
    df = spark.createDataFrame([(i, "the same line in every copy") for i in range(50)], "doc_id long, text string")
    assert line_templates.drop_recurring_lines(df, min_documents=5).where("n_dropped > 0").count() == 0


def test_long_passages_go_from_two_documents_on(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    tokens = passage.split()
    rows = [(1, f"own one\n{passage}"), (2, f"{passage}\nown two"), (3, passage + " and more"), (4, "short heading here"), (5, "short heading here\nx"), (6, None), (7, "hot line of five tokens")]
    rows += [(10 + i, " ".join(tokens[:12]) + f"\nmine {i}x") for i in range(4)] + [(20 + i, " ".join(tokens[3:15]) + f"\nmine {i}y") for i in range(3)]
    rows += [(100 + i, f"hot line of five tokens\n{i}q" * (1 + i % 3)) for i in range(300)] + [(500, "w " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_templates.drop_recurring_lines(df)
    dropped = {r.doc_id: r.n_dropped for r in got.collect()}
    assert dropped[1] == dropped[2] == 1 and dropped[3] == dropped[4] == dropped[5] == dropped[6] == dropped[500] == 0 and dropped[7] == 1
    assert all(dropped[10 + i] == 1 for i in range(4)) and all(dropped[20 + i] == 0 for i in range(3)) and all(dropped[100 + i] >= 1 for i in range(300))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert compare(got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")), con, line_templates.recurring_lines_sql()) is None


@pytest.mark.parametrize("small", [False, True])
def test_products_against_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 16), ("SPLIT", 4), ("STRIP", 8), ("HEAD", 6), ("LEVELS", 4)):
            monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(4)
    vecs = [(i, (r.normal(size=8) * r.choice((0.1, 1, 3))).tolist()) for i in range(120)]
    vecs += [(200 + i, vecs[0][1]) for i in range(30)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf"), 0.0]), (350, [0.5]), (400, [0.0] * 8), (10, vecs[10][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id long, embedding array<double>, score string")
    usable = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.in_units(F.col("embedding")).alias("vec"))
    got = {(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_products(usable, F.col("id") % 10 == 0).collect()}
    known = {i: [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)) for i, v in vecs if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in known if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(known[q], known[i])), i) for i in known if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_products(usable.limit(0), F.col("id") % 10 == 0).count() == 0
    assert topk.top_products(usable.where("vec_id in (0, 1)"), F.col("id") % 10 == 0).count() == 1
