"""The ridge model against its closed form, and what it is trained on."""

import numpy as np
import pytest

from listingscope.operators import ridge


def data(n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, 1]
    y = (x[:, 0] + x[:, 1] / 10 + rng.normal(size=n) > 1).astype(int)
    return [(i, float(a), float(b), float(c), 7.0, "abc"[i % 3], int(s)) for i, ((a, b, c), s) in enumerate(zip(x, y))]


SCHEMA = "listing_id int, a double, b double, c double, constant double, text string, suspect int"


@pytest.mark.parametrize("alpha", [1.0, 50.0])
def test_closed_form(table, alpha):
    rows = data()
    model = ridge.fit(table(SCHEMA, *rows), ["a", "b", "c", "constant"], "suspect", alpha, text_features=["text"])
    x = np.array([[r[1], r[2], r[3], "abc".index(r[5])] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    y = np.array([2.0 * r[6] - 1 for r in rows])
    want = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean()))
    found = dict(zip(model.features, model.weights))
    assert [found[k] for k in ("a", "b", "c", "text")] == pytest.approx(want, abs=1e-9)
    assert found["constant"] == 0 and model.intercept == pytest.approx(y.mean())
    scored = {r.listing_id: r for r in model.score(table(SCHEMA, *rows)).collect()}
    decision = z @ want + y.mean()
    assert scored[5].model_score == pytest.approx(1 / (1 + np.exp(-decision[5]))) and scored[5].text == rows[5][5]
    assert [scored[i].predicted for i in range(len(rows))] == [int(d > 0) for d in decision]


def test_unseen_and_missing_classes(table):  # I2, I6
    classes = ridge.encoder(table("t string", ("b",), ("a",), (None,)), "t")
    assert {r.value: r.code for r in classes.collect()} == {"a": 0, "b": 1, "nan": 2}
    codes = [r.t for r in ridge.encode(table("n int, t string", (1, "b"), (2, "zzz"), (3, None)), "t", classes).orderBy("n").collect()]
    assert codes == [1.0, 3.0, 2.0]
    known = ridge.encoder(table("t string", ("b",), ("unknown",), ("z",)), "t")
    assert ridge.encode(table("t string", ("zzz",)), "t", known).first().t == 1.0


def test_store_and_load(spark, table, tmp_path):  # I8
    df = table(SCHEMA, *data(60))
    model = ridge.fit(df, ["a", "b"], "suspect", text_features=["text"])
    model.save(spark, str(tmp_path / "m"), ridge.training_metadata(df, "suspect", model.features))
    again = ridge.load(spark, str(tmp_path / "m"), ["text"])
    a, b = ({r.listing_id: r.model_score for r in m.score(df).collect()} for m in (model, again))
    assert a == pytest.approx(b)
    meta = spark.read.json(str(tmp_path / "m" / "metadata")).first()
    assert meta.samples == 60 and meta.features == 3 and meta.trained_at
    top = model.importance(spark).collect()
    assert top[0].magnitude >= top[1].magnitude and {r.effect for r in top} <= {"raises", "lowers", "neutral"}


def test_feature_sets(table):  # T22
    df = table("listing_id long, score double, suspect int, price_gap double, rating double, degree long, suspects long, flag_instant_fraud int, brand string")
    assert ridge.feature_names(df) == (["rating", "degree", "suspects", "flag_instant_fraud"], ["brand"])
    assert ridge.feature_names(df, "no_leak") == (["rating", "degree"], ["brand"])
    with pytest.raises(ValueError):
        ridge.feature_names(df, "other")


def test_split_is_repeatable_and_whole(spark):
    df = spark.range(1000)
    (a, b), (c, _) = ridge.split(df, "id"), ridge.split(df, "id")
    assert a.count() + b.count() == 1000 and a.exceptAll(c).count() == 0 and 120 < b.count() < 280


def test_quality_of_nothing(table):
    q = ridge.quality(table("suspect int, predicted int")).first()
    assert (q.tp, q.precision, q.recall, q.f1) == (0, 0.0, 0.0, 0.0)
