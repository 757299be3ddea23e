"""Exact quantiles against numpy for every number of buckets."""

import numpy as np
import pytest

from listingscope.operators import quantiles

PROBS = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}


@pytest.mark.parametrize("buckets", [2, 16, 200])
def test_exact_quantiles(table, buckets):
    rng = np.random.default_rng(1)
    data = [("x", float(v)) for v in rng.normal(size=701)] + [("y", float(v)) for v in rng.integers(0, 5, 300)] + [("z", 4.0), ("w", None)]
    df = table("g string, v double", *data)
    found = {r.g: r for r in quantiles.exact_quantiles(df, "v", PROBS, ["g"], buckets).collect()}
    assert set(found) == {"x", "y", "z"}
    for g in found:
        values = [v for k, v in data if k == g]
        for name, p in PROBS.items():
            assert found[g][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    one = quantiles.exact_quantiles(df.where("g = 'x'"), "v", PROBS, (), buckets).first()
    assert one.c == pytest.approx(np.median([v for k, v in data if k == "x"]))


def test_histogram_edges(table):
    df = table("v double", (0.0,), (1.0,), (9.99,), (10.0,), (None,))
    assert {r.bin: r.n for r in quantiles.histogram(df, "v", 10).collect()} == {0: 1, 1: 1, 9: 2}
    assert quantiles.histogram(table("v double", (3.0,), (3.0,)), "v", 4).first().n == 2


def test_empty(table):
    none = table("v double")
    assert quantiles.exact_quantiles(none, "v", {"m": 0.5}).first().m is None
    assert quantiles.histogram(none, "v", 3).count() == 0


def test_values_between_fences_are_only_counted(spark):
    rows = spark.range(300_000).selectExpr("cast(id % 2 as string) g", "cast(hash(id) as double) v")
    kept = quantiles._counted(rows, "v", PROBS.values(), ["g"], quantiles.BUCKETS)
    assert kept.count() < 5_000 and kept.agg({"_n": "sum"}).first()[0] == 300_000
    found = {r.g: r for r in quantiles.exact_quantiles(rows, "v", PROBS, ["g"]).collect()}
    for g, values in rows.toPandas().groupby("g").v:
        assert [found[g][n] for n in PROBS] == pytest.approx(list(np.quantile(values, list(PROBS.values()))))


@pytest.mark.parametrize("buckets", [4, 10_000])
def test_fences_that_miss_are_drawn_wider(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "SMALL", 0)
    monkeypatch.setattr(quantiles, "ACCURACY", 5)
    rows = spark.range(4_000).selectExpr("cast(if(id % 3 = 0, 7, hash(id) % 1000) as double) v")
    found = quantiles.exact_quantiles(rows, "v", PROBS, (), buckets).first()
    assert list(found) == pytest.approx(list(np.quantile(rows.toPandas().v, list(PROBS.values()))))
