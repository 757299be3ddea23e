"""Similar pairs against brute force, with copies and a crowded cell."""

import numpy as np
import pytest

from listingscope.operators import graph, similarity


def vectors(seed=3, n=160, dim=6):
    """A third of the rows are one vector, a quarter another close to it, two have no direction."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = [base[i % 12] + rng.normal(scale=0.15, size=dim) for i in range(n)]
    for i in range(1, n, 4):
        rows[i] = base[0] + 0.01
    for i in range(0, n, 3):
        rows[i] = base[0]
    rows[1] = np.zeros(dim)
    return [(i, i % 9, None if i == 4 else [float(x) for x in rows[i]]) for i in range(n)]


def brute(rows, threshold):
    known = [(i, s, np.array(v)) for i, s, v in rows if v is not None and any(v)]
    pairs, edges = 0, {}
    for x in range(len(known)):
        for y in range(x + 1, len(known)):
            a, b = known[x], known[y]
            if a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) > threshold:
                pairs += 1
                if a[1] != b[1]:
                    key = min(a[1], b[1]), max(a[1], b[1])
                    edges[key] = edges.get(key, 0) + 0.5
    return len(known), pairs, edges


@pytest.mark.parametrize("threshold,block", [(0.85, 1), (0.98, 16), (0.3, 4), (0.85, 1000)])
def test_pairs_and_edges(spark, table, threshold, block):
    data = vectors()
    rows = table("listing_id long, seller_id long, vec array<double>", *data)
    valid, pairs, edges = brute(data, threshold)
    found = similarity.similarity_counts(rows, threshold, block=block).first()
    assert (found.valid, found.pairs) == (valid, pairs)
    nodes = rows.select("seller_id").distinct().selectExpr("seller_id", "1 AS listings", "0 AS suspects")
    for hub_size in (1000, 2, 1):
        same, near, wide = similarity.similarity_layer(rows, "t", threshold, hub_size, block=block)
        assert wide.isEmpty() == (hub_size == 1000)
        g = graph.build(nodes, [same], [near], hub_size, [wide])
        strength = {r.seller_id: r.total_weight for r in graph.neighbourhood(g).collect()}
        want = {s: sum(w for e, w in edges.items() if s in e) for s in range(9)}
        assert strength == pytest.approx(want)
        around = graph.summary(g).first()
        assert around.edges == len(edges)
        assert (around.weight_min, around.weight_max) == (min(edges.values()), max(edges.values()))


def test_workers_do_not_need_the_package(tmp_path):
    """The driver alone finds the package; its working folder and its workers' path do not hold it."""
    import os
    import subprocess
    import sys

    script = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from listingscope.plans import catalog
from listingscope.session import local_session
print("pairs", catalog.QUERIES["similarity_counts"](local_session(2), "/root/testdata/sf0.001").first().pairs)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "pairs " in done.stdout, done.stderr[-2000:]


def test_few_copies_and_few_rows_travel(spark, table):
    """A vector is sent to few blocks however small the smallest, and crowds need a hub per text, not per pair of texts."""
    rows = table("listing_id long, seller_id long, vec array<double>", *vectors())
    same, near, wide = similarity.similarity_layer(rows, "t", 0.3, 1, block=1)
    texts = same.select("key").distinct().count()
    assert 0 < wide.count() <= texts * 9
    units, _ = similarity.distinct_vectors(rows)
    seen = similarity._multiplied(units, 0.3, 1, lambda t, found: t.select(["vec_id"]), "vec_id long")
    assert seen.groupBy("vec_id").count().agg({"count": "max"}).first()[0] <= 2 * similarity.PARTS + 4
