"""Keyword automaton against counting substrings."""

import random

import pytest

from listingscope.operators import keywords


@pytest.mark.parametrize("part", [1000, 4])
def test_counts_as_substrings_do(spark, part):
    r = random.Random(part)
    words = [("a", "x"), ("aa", "x"), ("aba", "y"), ("b a", "y"), ("é", "x"), ("não é", "z"), ("aa", "z"), ("aa", "x"), ("", "x"), (None, "x"), ("never", "n"), ("A", "n")]
    texts = [(i % 7, "".join(r.choices(["a", "b", " ", "é", "A", "não "], k=r.randrange(0, 60)))) for i in range(60)] + [(1, None), (2, ""), (8, "a" * 100_000), (None, "aa")]
    docs = spark.createDataFrame(texts, "doc long, text string")
    got = {(row.doc, row["list"]): row.hits for row in keywords.keyword_hits(docs, spark.createDataFrame(words, "word string, list string"), ["doc"], part=part).collect()}
    want = {}
    for doc, text in texts:
        for word, name in {w for w in words if w[0]}:
            n = (text or "").lower().count(word)
            if n:
                want[doc, name] = want.get((doc, name), 0) + n
    assert got == want


def test_no_words_and_no_texts(spark):
    docs, words = spark.createDataFrame([(1, "a")], "doc long, text string"), spark.createDataFrame([(None, 1)], "word string, list int")
    assert keywords.keyword_hits(docs, words, ["doc"]).count() == 0
    assert keywords.keyword_hits(docs.limit(0), spark.createDataFrame([("a", 1)], "word string, list int"), ["doc"]).count() == 0


def test_overlaps_within_and_between_words():
    a = keywords.automaton_of(["aba", "ba", "b"])
    assert keywords.count_words(a, "ababa") == {0: 1, 1: 2, 2: 2}
