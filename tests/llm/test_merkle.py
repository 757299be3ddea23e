"""Merkle manifest against plain Python and DuckDB."""

from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from listingscope.llm import merkle
from tests.compare import compare

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, key string"


def h(text):
    return sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(leaves):
    """Root and proof (list of siblings) of every leaf."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            a = p - p % 16
            proofs[i].append((p % 16, [*level[a:p], *level[p + 1:a + 16]]))
        level = [h("".join(level[a:a + 16])) for a in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], proofs


def brute(rows, claims):
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded, verified) of rows with their claimed digests."""
    groups = defaultdict(list)
    for row, claim in zip(rows, claims):
        groups[row[1]].append((row[0], h("".join(map(field, row[:5]))), claim))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] is not None, x[2] or ""))
    trees = {s: grow([leaf for _, leaf, _ in groups[s]]) for s in names}
    root, over = grow([trees[s][0] for s in names])
    for s, upper in zip(names, over):
        for (key, leaf, claim), proof in zip(groups[s], trees[s][1]):
            whole = proof + upper
            folded = merkle.fold(claim or leaf, whole)
            yield key, s, leaf, trees[s][0], root, h("".join(x for _, siblings in whole for x in siblings)), folded, folded == root


def found(spark, rows, claimed=()):
    df = spark.createDataFrame(rows, SCHEMA)
    claim = F.when(F.col("doc_id").isin(list(claimed)), F.sha2(F.lit("other"), 256)) if claimed else None
    got = merkle.manifest(df, claim=claim, proofs=True)
    assert got.columns == ["doc_id", "source", "position", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
    got = got.collect()
    for r in got[:200]:
        if r.doc_id not in claimed:
            assert merkle.fold(r.leaf, [(x.digit, x.siblings) for x in r.proof]) == r.root
    want = brute(rows, [h("other") if r[0] in claimed else None for r in rows])
    assert sorted((tuple(r[c] for c in ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got), key=str) == sorted(want, key=str)
    return got


def test_odd_rows(spark):
    rows = [(i, s, None, 3, t, "x", "y") for i, s, t in (
        (3, "b", "abc"), (1, "b", None), (None, "b", ""), (None, None, "q"), (7, None, "é" * 9), (7, None, "é" * 9), (7, None, "é" * 9), (2, "", "z"), (2, "é", "z"), (9, "Z", "w " * 200_000))]
    rows += [(i, f"s{i % 19}", "en", i, f"text {i}", "x", "y") for i in range(100, 400)]
    got = found(spark, rows, claimed=(7, 110))
    assert {r.doc_id for r in got if not r.verified} == {7, 110}
    assert found(spark, rows[:1])[0].proof == []
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [4096, 4097, 70_001])
def test_blocks_and_rounds(spark, n):
    rows = [(i, "hot", None, None, None, "", "") for i in range(n)] + [(i, "t", None, None, "u", "", "") for i in range(17)]
    assert {r.doc_id for r in found(spark, rows, claimed=(5,)) if not r.verified} == {5}


def test_many_copies_of_one_row(spark):
    rows = [(1, "a", None, None, "same", "", "")] * 9000 + [(0, "a", None, None, "b", "", ""), (2, "a", None, None, "c", "", "")]
    got = found(spark, rows)
    assert sorted(r.position for r in got) == list(range(9002))


@pytest.mark.parametrize("blocks", [2, 16, 17, 33, 300])
def test_every_block_meets_all_roots(spark, blocks):
    """The exchange alone: after the last round every block has the root and the proof of its own leaf."""
    leaves = [h(str(i)) for i in range(blocks)]
    root, proofs = grow(leaves)
    at = spark.createDataFrame([("t", blocks, i, x) for i, x in enumerate(leaves)], "tree string, blocks long, block long, root string")
    steps, r = defaultdict(list), 0
    while blocks > 16 ** r:
        at = merkle.exchange(at, r).cache()
        for x in at.collect():
            steps[x.block].append((x.digit, x.siblings))
        at, r = at.select("tree", "blocks", "block", "root"), r + 1
    assert [steps[i] for i in range(blocks)] == proofs and {x.root for x in at.collect()} == {root}


def test_sql(spark):
    rows = [(i, s, None, 3, t, "x", "y") for i, s, t in ((3, "b", "ABC"), (1, "b", None), (None, "b", ""), (7, None, "É" * 9), (7, None, "É" * 9), (20, "é", "Zz"))]
    rows += [(i, f"s{i % 40}", "en", i, f"Text {i}", "x", "y") for i in range(100, 700)]
    df = spark.createDataFrame(rows, SCHEMA)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(df, claim=F.when(out, merkle.leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), low)))
    con = duckdb.connect()
    frame = df.toPandas()
    frame["doc_id"] = frame.doc_id.astype("Int64")
    con.register("documents", frame)
    assert compare(got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), con, merkle.manifest_sql()) is None
