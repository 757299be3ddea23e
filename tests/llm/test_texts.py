"""Benchmark windows, language and toxicity against plain Python."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from listingscope.llm import decontaminate, langid, toxicity
from listingscope.llm import wordbytes as wb

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window):
    def words(t):
        return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, named = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(window, len(v))
        for i in range(len(v) - m + 1 if v else 0):
            for j in range(len(w) - m + 1):
                if w[j:j + m] == v[i:i + m]:
                    hit.update(range(j, j + m))
                    if item is not None:
                        named.add(item)
    return len(w), hit, sorted(named)


@pytest.mark.parametrize("part_words", [2_000_000, 30])
def test_hits_are_those_of_every_place(spark, monkeypatch, part_words):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
    r = random.Random(5)
    vocabulary = ["ab", "a", "été", "x1", "b"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate((20, 13, 14, 3, 5, 30))]
    items += [(6, None), (7, "..."), (8, items[1][1].upper()), (None, items[0][1]), (9, "solo")]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate((0, 1, 4, 40, 700, 1200))]
    docs += [(10, items[0][1].replace(" ", ", ")), (11, None), (12, "!"), (13, "Solo"), (14, "q " * 600 + items[5][1]), (10, items[0][1].replace(" ", ", "))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for row in got:
        n, hit, named = brute_hits(text[row.doc_id], items, 13)
        marked = {p for s in row.spans for p in range(s["first"], s["first"] + s["words"])}
        assert (row.n_words, row.n_hit, marked, row["items"]) == (n, len(hit), hit, named), row.doc_id
    none = decontaminate.contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert {r.n_hit for r in none.collect()} == {0} and decontaminate.contamination(df.limit(0), df.select(df.doc_id.alias("item_id"), "text")).count() == 0


def test_languages_of_held_out_texts(spark):
    from listingscope.llm.queries import op4_language
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op4_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.96
    sure = got[~got.rejected]
    assert len(sure) > 0.95 * len(got) and got.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    rows = [(1, None, "q"), (2, "", "q"), (3, "123 !?", "q"), (4, "the cat and the dog", "q"), (5, "der Hund und die Katze " * 9000, "q"), (4, "the cat and the dog", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    dicts = {"de": b"der die das und Hund Katze ".lower() * 5, "en": b"the cat and the dog of an " * 5}
    got = sorted((r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(df, dicts).collect())
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False), (5, "de", False)]
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}
    assert langid.identify(df.limit(0), dicts).count() == 0
    taught = spark.createDataFrame([("abc def", "x"), (None, "x"), ("zzz", None)], "text string, lang string")
    assert langid.dictionaries(taught) == {"x": b"abc def"} and langid.dictionaries(taught.limit(0)) == {}


def test_copies_do_not_thin_a_dictionary_out(spark):
    few = spark.range(10000).selectExpr("concat('few words, text ', id % 20) text", "'x' lang")
    many = spark.range(1000).selectExpr("concat('many words, text ', id) text", "'y' lang")
    got = langid.dictionaries(few.unionByName(many))
    assert sorted(got["x"].decode().split("\n")) == sorted(f"few words, text {i}" for i in range(20))
    assert len(got["y"].split(b"\n")) == langid.SAMPLE


def best_sum(scores):
    return max([0.0] + [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)])


def test_segments_are_maximal():
    import numpy as np
    r = random.Random(2)
    for _ in range(200):
        scores = np.array([r.choice((-2, -1, -0.5, 1, 2, 3)) for _ in range(r.randrange(1, 12))], float)
        found = toxicity.segments(scores, 0.0)
        assert max([0.0] + [s for _, _, s in found]) == best_sum(scores.tolist())
        assert all(abs(scores[a:b].sum() - s) < 1e-9 for a, b, s in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        for a, b, _ in found:   # no part of a segment that begins or ends it may be without gain
            assert all(scores[a:i].sum() > 0 for i in range(a + 1, b + 1)) and all(scores[i:b].sum() > 0 for i in range(a, b))


def walked_segments(scores):
    """Ruzzo and Tompa with a walk over all candidates for every score, as the definition says."""
    sums, stack = [0.0, *itertools.accumulate(scores)], []
    for i, s in enumerate(scores):
        new = (i, i + 1, sums[i], sums[i + 1])
        while s > 0:
            j = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][2] < new[2]), -1)
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
    return [(a, b, r - left) for a, b, left, r in stack]


def test_segments_as_the_walk_finds_them():
    r = random.Random(5)
    for n in (1, 7, 60, 400):
        for _ in range(60):
            scores = [r.choice((-2.0, -1.0, -0.25, 0.5, 1.0, 3.0)) for _ in range(n)]
            for least in (0.0, 1.0, 4.0):
                assert toxicity.segments(np.array(scores), least) == [x for x in walked_segments(scores) if x[2] >= least]


def test_segments_take_linear_time():
    def seconds(n):
        scores = np.random.default_rng(1).choice((-0.1, -0.4, 0.1, 0.3), size=n, p=(0.5, 0.2, 0.2, 0.1))
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            toxicity.segments(scores, 1.0)
            best = min(best, time.perf_counter() - start)
        return best
    assert seconds(400_000) < 2.3 ** 3 * seconds(50_000)


def test_distinct_words_score_as_all_words_do():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=1 << toxicity.FEATURE_BITS), 6 * rng.normal(size=1 << toxicity.FEATURE_BITS), 1.0, 0.0, 1.0, 0.0)
    w = wb.words(pa.array(["the cat the dog é", None, "dog cats caterpillar the", ""]), wb.ALPHANUMERIC)
    each = [toxicity._word_scores(wb.words(pa.array([w.data[a:b].tobytes().decode()]), wb.ALPHANUMERIC), model)[0] for a, b in zip(w.starts, w.ends)]
    assert toxicity._word_scores(w, model).tolist() == each
    assert len(toxicity._word_scores(wb.words(pa.array(["", None]), wb.ALPHANUMERIC), model)) == 0


def test_a_key_that_repeats_in_the_labels_is_chosen_once(spark):
    labels = spark.createDataFrame([(1, 1)] * 500 + [(1, 0)] + [(2, 0), (3, 1), (3, 0)], "doc_id long, toxic int")
    chosen, share = toxicity.choose(labels)
    assert sorted(map(tuple, chosen.collect())) == [(1, 1), (2, 0), (3, 1)] and share == 2 / 3


def test_toxicity_of_held_out_texts(spark):
    from listingscope.llm.queries import op8_toxicity
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    ranks = got.score.rank()
    auc = (ranks[got.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.9 and (toxic.predicted == 1).mean() > 0.6 and (clean.predicted == 1).mean() < 0.05


def test_toxicity_of_odd_tables(spark):
    rows = [(i, ("good nice fine day " * 3) if i % 2 else "vile rotten scum day good nice", i % 2 == 0, "s") for i in range(200)]
    taught = spark.createDataFrame([(i, f"{t} u{i}", int(y), s) for i, t, y, s in rows], "doc_id long, text string, toxic int, score string")
    model = toxicity.learn(taught)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "good nice"), (4, "you vile rotten scum"), (4, "you vile rotten scum"), (5, "fine " * 90000)], "doc_id long, text string")
    got = sorted(map(tuple, toxicity.score(odd, model).select("doc_id", "score").collect()))
    score = dict(got)
    assert len(got) == 6 and score[1] == score[2] and score[4] > 0.5 > max(score[3], score[1], score[5]) and all(0 <= s <= 1 for _, s in got)
    passages = toxicity.score(odd.where("doc_id = 4").limit(1), model).first().passages
    assert passages and passages[0]["first"] == 1 and passages[0]["words"] == 3
    for one_sided in (taught.where("toxic = 0"), taught.limit(0)):
        assert {r.score for r in toxicity.score(odd, toxicity.learn(one_sided)).collect()}.pop() <= 0.5
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_repeated_texts_teach_once(spark):
    import numpy as np
    r = random.Random(4)
    neutral = ["good", "nice", "fine", "day", "tree", "house", "river", "stone"]
    rows = [(" ".join(r.choice(neutral) for _ in range(12)) + (" vile scum" if i % 3 == 0 else "") + f" u{i}", int(i % 3 == 0)) for i in range(600)]
    schema = "text string, toxic int"
    once = toxicity.learn(spark.createDataFrame(rows + [("moon sky", 0)], schema), share_toxic=0.3)
    # The copies' label is that of most rows.
    often = toxicity.learn(spark.createDataFrame(rows + [("moon sky", 0)] * 2000 + [("moon sky", 1)] * 9, schema), share_toxic=0.3)
    assert np.array_equal(once.odds, often.odds) and np.array_equal(once.z, often.z)
    assert (once.rate, once.log_k) == (often.rate, often.log_k) and abs(once.slope - often.slope) < 1e-9 and abs(once.base - often.base) < 1e-9


def test_all_ranks_count(spark):
    import numpy as np
    import pyarrow as pa

    from listingscope.llm import wordbytes as wb
    cell = toxicity._cells(wb.words(pa.array(["vile"]), wb.ALPHANUMERIC))[0, 0]
    odds, z = np.zeros(1 << toxicity.FEATURE_BITS, np.float32), np.zeros(1 << toxicity.FEATURE_BITS, np.float32)
    odds[cell], z[cell] = 1.5, 9.0
    model = toxicity.Model(odds, z, 1.0, -8.0, 1.0, 0.0)
    text = ("vile" + " calm" * 19 + " ") * 40
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().surprise
    want = toxicity._surprise(model, 800, [float(odds[cell]) - toxicity.DRIFT] * 40)
    assert abs(got - want) < 1e-3 and want > toxicity._surprise(model, 800, [1.4] * 16) + 1
