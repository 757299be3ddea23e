"""License scan against plain Python."""

import random
import re

import pytest

from listingscope.llm import licenses, queries

WORD = re.compile(licenses.WORD.encode().decode("unicode_escape"))
SCHEMA = "label string, text string, percent int, phrase boolean"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, templates):
    """Sorted places (label, first) and blocks (label, first, words, share): every block against every clause."""
    w, places, blocks = words(text), [], set()
    for label, t, percent, phrase in set(templates):
        if label is None or percent is None or not 1 <= percent <= 100:
            continue
        v = words(t)
        if phrase and v:
            places += [(label, i) for i in range(len(w) - len(v) + 1) if w[i:i + len(v)] == v]
            continue
        cuts = -(-len(v) // 32)
        for own in {tuple(v[i * len(v) // cuts:(i + 1) * len(v) // cuts]) for i in range(cuts)}:
            for k in range(0, len(w), 32):
                held = w[k:k + 64]
                share = len(set(held) & set(own)) / len(set(own))
                if len(set(held) & set(own)) * 100 >= percent * len(set(own)):
                    blocks.add((label, k, len(held), share))
    return sorted(places), sorted(blocks)


def check(spark, texts, templates, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, places string, id int")
    known = spark.createDataFrame(templates, SCHEMA)
    got = {r.doc_id: r for r in licenses.scan(docs, known, **options).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        places, blocks = brute(t, templates)
        assert got[i].n_words == len(words(t))
        assert sorted((p.label, p.first) for p in got[i].places) == places, t
        # A candidate lies in every block that reaches it; blocks of one clause and label are one find.
        assert sorted({(b.label, b.first, b.words, b.share) for b in got[i].blocks}) == blocks, t
    return got


@pytest.mark.parametrize("part", [1000, 3])
def test_random_texts_and_templates(spark, part):
    r = random.Random(part)
    names = [f"w{i}" for i in range(30)] + ["é", "12", "w x"]
    texts = [" ".join(r.choices(names, weights=range(1, 34), k=r.randrange(0, 260))) for _ in range(60)]
    templates = [(f"l{i % 5}", " ".join(r.choices(names, k=r.randrange(1, 70))), r.choice((50, 80, 100)), False) for i in range(12)]
    templates += [("p", " ".join(r.choices(names, k=k)), 100, True) for k in (1, 1, 2, 2, 3)] + [("q", "w1 w1", 100, True), ("r", "w31 w31 w30", 100, True)]
    texts += [" ".join(t.split() * 3) for _, t, _, _ in templates]
    check(spark, texts, templates, part=part)


def test_places_on_the_borders_of_blocks(spark):
    for at in (0, 30, 31, 32, 33, 62, 63, 64):
        text = " ".join(["x"] * at + ["General", "PUBLIC", "license"] + ["y"] * 3)
        got = check(spark, [text], [("gpl", "general public license", 100, True), (None, "x", 100, True), ("none", "", 80, False), ("bad", "y", 0, True)])
        assert [(p.label, p.first) for p in got[0].places] == [("gpl", at)]
    long_phrase = " ".join(f"a{i}" for i in range(32))
    check(spark, ["z " * 31 + long_phrase, "z " * 40 + long_phrase + " z " + long_phrase], [("long", long_phrase, 100, True)])
    with pytest.raises(Exception, match="a phrase has more than"):
        check(spark, ["a"], [("long", "b " * 33, 100, True)])


def test_odd_tables(spark):
    many = "MIT license " * 100_000
    texts = [None, "", " \n", "the mit-license", "MIT License. mit\nlicense", many, "released under the Apache License and the GNU General Public License", "an omit license"]
    got = check(spark, texts, [("mit", "mit license", 100, True), ("apache", "apache license", 100, True)])
    assert len(got[5].places) == 100_000 and len(got[4].places) == 2 and not got[7].places
    check(spark, texts, [])
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "mit license"), (1, "no")], "doc_id long, text string")
    assert sorted((r.doc_id is None, len(r.places)) for r in licenses.scan(twice, part=1).collect()) == [(False, 0), (False, 1), (False, 1), (True, 1)]


def test_known_templates_find_their_licenses_and_nothing_else(spark):
    texts = [t for _, _, t in licenses.TEMPLATES] + ["We met at MIT and ran a license plate office; the software is free of charge and the copyright notice was above."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {b.label for b in r.blocks} for r in licenses.scan(docs).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i]
    assert got[len(texts) - 1] == set()


def test_query_finds_the_base_labels(spark):
    rows = queries.op11_license_scan(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.first_word is None) == (r.n_base == 0) == (r.base_labels == "")
