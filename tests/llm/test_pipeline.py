"""Stages against brute force, and every query with SQL against DuckDB."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listingscope.llm import langid, queries, sharding
from tests.compare import compare, connect
from tests.llm.test_near_duplicates import brute
from tests.llm.test_texts import brute_hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None


def test_stages_in_order_and_by_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    coder = langid.Coder(langid.dictionaries(docs))
    want = {i for i, t in held.items() if not coder.judge(t)[2]}
    one = corpus_pipeline.language(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == want and one.columns == columns and len(want) > 0.9 * len(held)

    two = corpus_pipeline.near_duplicates(spark, one, SF)
    want = {i for i, (_, c) in brute([(i, held[i]) for i in want], 5).items() if i == c}
    assert sorted(r.doc_id for r in two.collect()) == sorted(want) and two.columns == columns

    three = corpus_pipeline.decontamination(spark, two, SF)
    def bad(text):
        n, hit, _ = brute_hits(text, items, 13)
        return bool(hit) and 20 * len(hit) >= n
    want = {i for i in want if not bad(held[i])}
    assert sorted(r.doc_id for r in three.collect()) == sorted(want) and three.columns == columns

    four = corpus_pipeline.mixture(spark, three, SF)
    rows = four.collect()
    assert four.columns == columns and all(len(r.text) == r.n_chars for r in rows)
    assert all(set(r.text.split()) <= set(held[r.doc_id].split()) for r in rows)
    words = three.select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))).first()[0]
    assert abs(sum(len(r.text.split()) for r in rows) - words) <= 20

    five = corpus_pipeline.shards(spark, four, SF)
    assert five.count() == len(rows) and five.where(F.col("shard").isNull() | (F.col("shard_bytes") > sharding.LIMIT)).count() == 0


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    def text(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))
    rows = [(3, text("c")), (7, text("a")), (7, text("c") + " more"), (7, text("c")), (8, text("a") + " more"), (8, text("b")), (8, text("b")), (9, ""), (9, None), (8, " "),
            *((5, text(f"u{i}x")) for i in range(20)), (None, text("c"))]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = [(3, text("c")), (7, text("a")), (8, text("b")), (9, ""), (9, None), (8, " "), *((5, text(f"u{i}x")) for i in range(20)), (None, text("c"))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str) and got.columns == docs.columns


def test_stages_take_odd_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the cat and the dog sat on the mat", "en", None, 34),
            (3, "the cat and the dog sat on the mat", "en", "a", 34), (3, "the cat and the dog sat on the mat", "en", "a", 34), (4, "9 9", None, "b", 3)]
    # Copies with one id are one document; the null source's weight of 2 of 3 asks for 12 words of its 9, so its text is taken a second time in part.
    left = {"language": 3, "near_duplicates": 2, "decontamination": 2, "mixture": 3, "shards": 3}
    for table in (rows, []):
        docs = spark.createDataFrame([(*r, 1, "q") for r in table], "doc_id long, text string, lang string, source string, n_chars long, _t int, shard string")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.count() == (left[name] if table else 0), name
        if table:
            assert sorted((r.doc_id or 0, len(r.text.split())) for r in docs.select("doc_id", "text").collect()) == [(0, 3), (0, 9), (3, 6)]
