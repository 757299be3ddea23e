"""Whitening against NumPy and exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from listingscope.llm import queries, topk, whitening

SCHEMA = "vec_id long, vec array<float>, component string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)


def whole(v, d):
    v = [float(np.float32(x)) for x in v] + [0.0] * (d - len(v))
    return [math.floor(64 * x) + 1_000_000 for x in v]


def run(spark, rows):
    df = table(spark, rows).where(topk.usable(topk.F.col("vec")))
    model = whitening.fit(df)
    return model, whitening.whiten(df, model).collect(), whitening.identity_error(df, model)


def covariance(x):
    """In fractions, over the rows."""
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])


@pytest.mark.parametrize("d,n,scale", [(1, 9, 1.0), (5, 40, 1.0), (40, 90, 3.0), (4, 30, 1e14)])
def test_against_fractions(spark, d, n, scale):
    rng = np.random.default_rng(d)
    rows = [(i, (rng.normal(size=d) * scale * (1 + np.arange(d))).tolist()) for i in range(n)]
    rows += [(n, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])]
    bad = [(91, None), (92, [None] * d), (93, [float("nan")] * d), (94, [float("-inf")] * d)]
    model, got, error = run(spark, rows + bad)
    x = [whole(v, d) for _, v in rows]
    sums = [sum(r[i] for r in x) for i in range(d)]
    v = covariance(x)
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(32, d)
    assert len(got) == len(rows) * k and error < 1e-4 and model.n == len(rows)
    assert np.allclose([r.explained for r in got if r.vec_id == 1], e[:k] / np.trace(v), rtol=1e-6)
    w = np.array([[r.whitened for r in sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)[:k]] for i, _ in rows[1:n]])
    off = np.array([[float(Fraction(a) - Fraction(s, len(x))) for a, s in zip(r, sums)] for r in x[1:n]])
    assert np.allclose(w, off @ model.axes[:, :k] / np.sqrt(e[:k]), atol=1e-6)
    assert np.allclose(v @ model.axes, model.axes * model.values, atol=1e-9 * e[0]) and np.allclose(model.axes.T @ model.axes, np.eye(d))
    for r in got:
        if r.vec_id is not None and 0 < r.vec_id < n:
            exact = sum((len(x) * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
            assert r.deviation == (exact if exact < 1 << 63 else None) and r.n == len(x)


def test_equal_rows_short_rows_and_empty_tables(spark):
    model, got, error = run(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert error == 0 and {(r.deviation, r.whitened, r.explained) for r in got} == {(0, None, 0.0)} and len(got) == 10
    model, got, error = run(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, []), (4, [0.0, 0.0])])
    assert len(got) == 8 and error < 1e-9 and abs(sum(r.whitened for r in got)) < 1e-9
    one_dead = [(i, [float(i), 3.0]) for i in range(6)]
    model, got, error = run(spark, one_dead)
    assert error < 1e-9 and all((r.whitened is None) == (r.component == 2) for r in got)
    for rows in ([], [(1, None)]):
        model, got, error = run(spark, rows)
        assert got == [] and error == 0


def test_extreme_entries_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])]
    _, got, error = run(spark, rows)
    assert len(got) == 6 and all((r.deviation is None) == (r.vec_id != 3) for r in got) and error < 1e-4


def test_sums_are_exact_beyond_64_bits():
    y = np.array([[1 << 40, -(1 << 41)], [3, 1 << 40]])
    assert whitening._square_sums(y) == [[(1 << 80) + 9, (1 << 80) + ((1 << 40) + 3) ** 2], [(1 << 82) + (1 << 80)]]
    for v in (0, 1, -1, (1 << 200) + 5, -(1 << 90) - 7):
        assert sum(d << (30 * p) for p, d in whitening._digits(v)) == v


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_whitening(spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in rows], float)
    off = x - x.mean(axis=0)
    e = np.linalg.eigvalsh(off.T @ off / len(x))[::-1]
    assert len(got) == len(rows) * min(32, x.shape[1]) and got.identity_error.max() < 1e-8
    assert np.allclose(got[got.vec_id == rows[0].vec_id].sort_values("component").explained, e[:32] / e.sum(), rtol=1e-6)
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(w.T @ w / len(w), np.eye(w.shape[1]), atol=1e-6)
