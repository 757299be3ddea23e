"""Components against all pairs of whole sets; nulls, empties, ties, clashing columns."""

import random
import re

import numpy as np
import pytest

from listingscope.llm import minhash
from listingscope.llm.links import smallest_reachable

SCHEMA = "doc_id long, text string, component_id string, kept string"


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    s = [(i, sets(t, k)) for i, t in rows]
    root = {i: i for i, _ in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(s):
        for j, b in s[n + 1:]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in s}


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice((1, 3, 30, 80, 200)))]
        for _ in range(r.choice((1, 2, 9))):
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((n, " ".join(own).upper() if n % 5 == 0 else "\t".join(own)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, rows[3][1]), (n + 4, rows[3][1]), (n + 5, "x " * 50000)]


@pytest.mark.parametrize("words, small", [(2, True), (5, False)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, words, small):
    if small:
        for name, size in (("CHUNK", 2), ("BLOCK", 3), ("GUESTS", 2)):
            monkeypatch.setattr(minhash, name, size)
    rows = corpus(words)
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, words=words).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute(rows, words).items()}
    assert got == want


def test_rows_without_key_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c", "", ""), (None, "a b c", "", ""), (7, "a b c", "", ""), (7, "a b c", "", "")], SCHEMA)
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, True)] * 2 + [(7, 1, 7, True)] * 2, key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(df, percent=50)


def test_sketches_estimate_similarity_at_every_size():
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 3000):
        both = r.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.concatenate((both, r.integers(0, 2**63, n // 5, dtype=np.uint64))) for _ in range(2))
        x, y = minhash.sketches([a, b])
        assert abs((x == y).mean() - n / (n + 2 * (n // 5))) < 0.2


def test_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(5, 5)], "a long, b long")
    got = dict(map(tuple, smallest_reachable(edges).collect()))
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}
