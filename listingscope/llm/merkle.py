"""Merkle manifest of a table: a tree per group of rows, a tree over the groups' roots, and the proof of every row.

Every FANOUT consecutive nodes become the digest of their hexadecimal digests, level by level, until one is left. Rows are ranked inside their group
by a range sort of their digests (texts never move), and each aligned run of BLOCK ranks is a block that one task hashes up to the block's root.

Above the blocks the trees grow by a butterfly exchange. In round r the blocks that agree in every base-FANOUT digit of their number except digit r
swap the roots of their subtrees, so each of them hashes the same ancestor for itself and keeps the other roots as its next proof level. After
the last round every block has its whole upper proof and the root; nothing is sent down again. A round is one shuffle with FANOUT rows a key.
Where the last subtree of a group has fewer blocks than the others, its blocks also stand in for the missing addresses.

Equal rows travel as one row with a number of copies and become single leaves inside the blocks only, so no number of copies makes a large task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb
from listingscope.session import cut, discard

FANOUT = 16
DEPTH = 3                 # levels inside a block
BLOCK = FANOUT ** DEPTH
SPAN = 1024               # blocks that share one row of their group's upper proof
MOST_ROUNDS = 12          # 16^12 blocks: more rows than a 63-bit rank can number
STEP = "array<struct<digit:int,siblings:array<string>>>"


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """Hexadecimal digest of the fields of a row."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(leaf: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its proof, (place in the run, siblings) per level, lead to."""
    for digit, siblings in proof:
        leaf = sha256("".join([*siblings[:digit], leaf, *siblings[digit:]]).encode()).hexdigest()
    return leaf


def _height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _levels(leaves: list[bytes], height: int) -> list[list[bytes]]:
    """Digests of the leaves and of each level above them."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        out.append([sha256(b"".join(below[i:i + FANOUT])).hexdigest().encode() for i in range(0, len(below), FANOUT)])
    return out


def _digests(block: pa.StructScalar | dict, name: str) -> list[bytes | None]:
    return [x for row in block for x in [row[name].hex().encode() if row[name] is not None else None] * row["copies"]]


# ---------------------------------------------------------------- one forest: ranks, blocks, rounds

def _ranked(leaves: DataFrame) -> DataFrame:
    """(tree, n, first, copies, key, leaf, claim): the rank of each row's first copy in its tree of n leaves."""
    order = ["tree", "key", "leaf", "claim"]
    stored = cut(leaves.groupBy(*order).agg(F.count(F.lit(1)).alias("copies")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, 0
        for batch in batches:
            firsts = []
            for t, copies in zip(batch.column("tree").to_pylist(), batch.column("copies").to_pylist()):
                if t != tree:
                    tree, at = t, 0
                firsts.append(at)
                at += copies
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(firsts, pa.int64())], [*batch.schema.names, "at"])

    laid = stored.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"))
    rows = cut(laid.mapInArrow(number, T.StructType([*laid.schema.fields, T.StructField("at", T.LongType())])))
    discard(stored)
    # A partition holds a run of the order: (part, tree) has at most as many rows as there are partitions and trees together.
    held = rows.groupBy("part", "tree").agg(F.sum("copies").alias("here"))
    own = Window.partitionBy("tree")
    upto = F.sum("here").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = held.select("part", "tree", (upto - F.col("here")).alias("start"), F.sum("here").over(own).alias("n"))
    return rows.join(starts, ["part", "tree"]).select("tree", "n", (F.col("start") + F.col("at")).alias("first"), "copies", "key", "leaf", "claim")


def _blocked(leaves: DataFrame) -> DataFrame:
    """(tree, n, block, leaves): the leaves of an aligned run of BLOCK ranks, as pieces of equal rows in the order of their ranks."""
    end = F.col("first") + F.col("copies")
    pieces = _ranked(leaves).withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((end - 1) / BLOCK))))
    start = F.greatest(F.col("first"), F.col("block") * BLOCK)
    stop = F.least(end, (F.col("block") + 1) * BLOCK)
    pieces = pieces.select("tree", "n", "block", F.struct(start.alias("first"), (stop - start).cast("int").alias("copies"), "key", "leaf", "claim").alias("piece"))
    return cut(pieces.groupBy("tree", "n", "block").agg(F.array_sort(F.collect_list("piece")).alias("leaves")))   # at most BLOCK pieces


def _block_roots(blocks: DataFrame) -> DataFrame:
    """(tree, blocks, block, root)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for n, block in zip(batch.column("n").to_pylist(), batch.column("leaves")):
                roots.append(_levels(_digests(block.as_py(), "leaf"), min(DEPTH, _height(n)))[-1][0].decode())
            counts = [-(-n // BLOCK) for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), pa.array(counts, pa.int64()), batch.column("block"), pa.array(roots, pa.string())], ["tree", "blocks", "block", "root"])

    return blocks.mapInArrow(run, "tree string, blocks long, block long, root string")


def exchange(nodes: DataFrame, r: int) -> DataFrame:
    """Round r of (tree, blocks, block, root): each block with its place ``digit`` among the subtrees that met, their roots and the new root.

    Keys are the addresses that blocks of neighbouring subtrees share. A subtree with fewer blocks than FANOUT^r (the last one) repeats its blocks over
    the missing addresses if there is a subtree before it.
    """
    wide = FANOUT ** r
    low, base = F.col("block") % wide, F.col("block") - F.col("block") % wide
    digit = F.floor(F.col("block") / wide) % FANOUT
    width = F.least(F.lit(wide), F.col("blocks") - base)
    last = F.when(digit == 0, width - 1).otherwise(F.lit(wide - 1))
    sent = nodes.select(
        "tree", "blocks", "block", "root", digit.cast("int").alias("digit"), low.alias("low"), F.floor(F.col("block") / (wide * FANOUT)).alias("above"),
        F.explode(F.sequence(low, last, width)).alias("address"))
    met = sent.groupBy("tree", "blocks", "above", "address").agg(
        F.array_sort(F.collect_list(F.struct("digit", "block", "root", (F.col("low") == F.col("address")).alias("own")))).alias("met"))   # FANOUT rows
    roots = F.transform("met", lambda x: x["root"])
    back = met.select("tree", "blocks", "met", F.sha2(F.array_join(roots, ""), 256).alias("root"), F.explode(F.filter("met", lambda x: x["own"])).alias("me"))
    siblings = F.transform(F.filter("met", lambda x: x["digit"] != F.col("me.digit")), lambda x: x["root"])
    return back.select("tree", "blocks", "me.block", "root", "me.digit", siblings.alias("siblings"))


def _forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees of leaves (tree, key, leaf, claim): the blocks, each block's upper proof (tree, blocks, block, upper) and the roots (tree, blocks, root)."""
    blocks = _blocked(leaves)
    nodes = cut(_block_roots(blocks))
    widest = nodes.agg(F.max("blocks")).first()[0] or 1
    ends, steps = [], []
    at = nodes
    for r in range(MOST_ROUNDS):
        ends.append(at.where((F.col("block") == 0) & (F.col("blocks") <= FANOUT ** r)).select("tree", "blocks", "root"))
        if widest <= FANOUT ** r:
            break
        done = cut(exchange(at.where(F.col("blocks") > FANOUT ** r), r))
        steps.append(done.select("tree", "block", F.struct(F.lit(r).alias("r"), "digit", "siblings").alias("step")))
        at = done.select("tree", "blocks", "block", "root")
    roots = ends[0]
    for e in ends[1:]:
        roots = roots.unionByName(e)
    if not steps:
        return blocks, nodes.select("tree", "blocks", "block", F.array().cast(STEP).alias("upper")), roots
    climbed = steps[0]
    for s in steps[1:]:
        climbed = climbed.unionByName(s)
    ordered = F.transform(F.array_sort(F.collect_list("step")), lambda s: F.struct(s["digit"].alias("digit"), s["siblings"].alias("siblings")))
    climbed = climbed.groupBy("tree", "block").agg(ordered.alias("upper"))   # a row per round
    upper = nodes.select("tree", "blocks", "block").join(climbed, ["tree", "block"], "left")
    return blocks, upper.select("tree", "blocks", "block", F.coalesce("upper", F.array().cast(STEP)).alias("upper")), roots


# ---------------------------------------------------------------- proofs of the leaves

_PROOF = T.StructType([
    T.StructField("position", T.LongType()), T.StructField("leaf", T.StringType()), T.StructField("proof", T.ArrayType(T.StructType([
        T.StructField("digit", T.IntegerType()), T.StructField("siblings", T.ArrayType(T.StringType()))]))),
    T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()), T.StructField("verified", T.BooleanType())])


def _proved(blocks: DataFrame, proofs: bool) -> DataFrame:
    """A row per leaf of blocks (tree, n, block, leaves, upper, subroot, root): its proof's digest and the root its claimed digest folds to."""
    kind = next(f.dataType for f in blocks.schema["leaves"].dataType.elementType.fields if f.name == "key")
    fields = [f for f in _PROOF.fields if proofs or f.name != "proof"]
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("key", kind), T.StructField("subroot", T.StringType()),
                           T.StructField("root", T.StringType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name)[i] for name in batch.schema.names}
                rows = one["leaves"].as_py()
                n, root = one["n"].as_py(), one["root"].as_py()
                levels = _levels(_digests(rows, "leaf"), min(DEPTH, _height(n)))
                claims = _digests(rows, "claim")
                upper = [(s["digit"], [x.encode() for x in s["siblings"]]) for s in one["upper"].as_py()]
                above = b"".join(x for _, siblings in upper for x in siblings)
                folded, digests, spelled = [], [], []
                for at, leaf in enumerate(levels[0]):
                    state, hashed, place, here = claims[at] or leaf, sha256(), at, []
                    for level in levels[:-1]:
                        a, digit = place - place % FANOUT, place % FANOUT
                        left, right = level[a:place], level[place + 1:a + FANOUT]
                        before, after = b"".join(left), b"".join(right)
                        hashed.update(before + after)
                        state = sha256(before + state + after).hexdigest().encode()
                        place //= FANOUT
                        if proofs:
                            here.append({"digit": digit, "siblings": [x.decode() for x in left + right]})
                    hashed.update(above)
                    for digit, siblings in upper:
                        state = sha256(b"".join([*siblings[:digit], state, *siblings[digit:]])).hexdigest().encode()
                    folded.append(state.decode())
                    digests.append(hashed.hexdigest())
                    spelled.append(here)
                count = len(folded)
                held = batch.column("leaves")[i].values
                turns = [j for j, row in enumerate(rows) for _ in range(row["copies"])]
                first = one["block"].as_py() * BLOCK
                columns = [
                    pa.array([one["tree"].as_py()] * count, pa.string()), held.field("key").take(pa.array(turns, pa.int64())),
                    pa.array([one["subroot"].as_py()] * count, pa.string()), pa.array([root] * count, pa.string()),
                    pa.array(range(first, first + count), pa.int64()), pa.array([x.decode() for x in levels[0]])]
                if proofs:
                    whole = [{"digit": d, "siblings": [x.decode() for x in s]} for d, s in upper]
                    columns.append(pa.array([own + whole for own in spelled], pa.list_(pa.struct([("digit", pa.int32()), ("siblings", pa.list_(pa.string()))]))))
                columns += [pa.array(digests), pa.array(folded), pa.array([x == root for x in folded])]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return blocks.mapInArrow(run, schema)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "source",
             claim: Column | None = None, proofs: bool = False) -> DataFrame:
    """(key, group, position, leaf, subroot, root, proof_sha256, folded_root, verified), and ``proof`` if asked for, of every row.

    A leaf is the digest of ``columns`` (null: ``-``, else byte count, colon, value). Leaves of a group ascend by key, null first, then by digest; groups
    ascend by name, null first, in bytes of UTF-8. ``claim`` is another digest (hex) of a row to be proved in place of its leaf, null for the leaf
    itself: ``folded_root`` is what it and the leaf's siblings lead to, ``verified`` whether that is the root.

    A single leaf is its group's root and a single group's root is the root; the proof of a single row is empty. Rows that are equal in ``columns``
    are leaves of their own with equal digests. Empty and very long texts are values like others; other columns are not read, so their names may
    be anything. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    wb.bounded_batches(spark)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))   # null sorts before every name
    digest = leaf_digest(*map(F.col, columns))
    claim = F.lit(None).cast("string") if claim is None else claim
    leaves = docs.select(tree.alias("tree"), F.col(key).alias("key"), F.unhex(digest).alias("leaf"), F.unhex(claim).alias("claim"))
    blocks, upper, subroots = _forest(leaves)
    subroots = cut(subroots)
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.unhex("root").alias("leaf"), F.lit(None).cast("binary").alias("claim"))
    top_blocks, top_upper, top = _forest(groups)
    top = top.select(F.col("tree"), F.col("root").alias("top"))   # one row
    top_blocks = top_blocks.join(top_upper.drop("blocks"), ["tree", "block"]).join(top, "tree")
    over = _proved(top_blocks.withColumn("subroot", F.col("top")).withColumnRenamed("top", "root"), True)
    over = over.select(F.col("key").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("over"))
    # A group's upper proof goes to its blocks in spans, so that a group with a third of all blocks is dealt over many keys.
    over = over.join(subroots.select("tree", "blocks"), "tree").withColumn("span", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / SPAN))))
    upper = upper.withColumn("span", F.floor(F.col("block") / SPAN)).join(over.drop("blocks"), ["tree", "span"])
    upper = upper.select("tree", "block", F.concat("upper", "over").alias("upper"), "subroot", "root")
    proved = _proved(blocks.join(upper, ["tree", "block"]), proofs)
    name = F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).cast(docs.schema[group].dataType)
    rest = [f.name for f in _PROOF.fields if f.name not in ("position", "leaf") and (proofs or f.name != "proof")]
    return proved.select(F.col("key").alias(key), name.alias(group), "position", "leaf", "subroot", "root", *rest)


def manifest_sql(levels: int = 7) -> str:
    """The registered query's rows in DuckDB, for sources of at most 16^levels documents and as many sources."""
    def fields(text: str) -> str:
        def one(value: str, size: str) -> str:
            return f"coalesce(CAST({size} AS VARCHAR) || ':' || {value}, '-')"
        def number(c: str) -> str:
            return one(f"CAST({c} AS VARCHAR)", f"length(CAST({c} AS VARCHAR))")
        return " || ".join([number("doc_id"), one("source", "strlen(source)"), one("lang", "strlen(lang)"), number("n_chars"), one(text, f"strlen({text})")])

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))), lambda c, b: {bits}), 4294967295)"

    def grow(name: str, start: str) -> str:
        """Levels name_0 .. name_levels of (tree, p, d), and each leaf's way up: (id, p, d folded, proof so far)."""
        out = [f"{name}_0 AS ({start})"]
        for k in range(levels):
            out.append(f"""{name}_{k + 1} AS (
  SELECT tree, p // {FANOUT} AS p, CASE WHEN any_value(w) > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM {name}_{k}) GROUP BY tree, p // {FANOUT})""")
        return ",\n".join(out)

    def climb(way: str, name: str) -> str:
        out = []
        for k in range(levels):
            out.append(f"""{way}_{k + 1} AS (
  SELECT l.id, l.tree, l.p // {FANOUT} AS p, CASE WHEN any_value(w) > 1 THEN sha256(string_agg(CASE WHEN m.p = l.p THEN l.d ELSE m.d END, '' ORDER BY m.p)) ELSE any_value(l.d) END AS d,
         any_value(l.proof) || coalesce(string_agg(m.d, '' ORDER BY m.p) FILTER (WHERE m.p <> l.p), '') AS proof
  FROM {way}_{k} l JOIN (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM {name}_{k}) m ON l.tree = m.tree AND l.p // {FANOUT} = m.p // {FANOUT}
  GROUP BY l.id, l.tree, l.p)""")
        return ",\n".join(out)

    return f"""
WITH leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS tree, sha256({fields('text')}) AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN sha256({fields(low)}) END AS claim FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS p FROM leaves),
{grow('t', 'SELECT tree, p, leaf AS d FROM placed')},
w_0 AS (SELECT id, tree, p, coalesce(claim, leaf) AS d, '' AS proof FROM placed),
{climb('w', 't')},
{grow('s', f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS p, d FROM t_{levels}")},
named AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS p FROM t_{levels}),
v_0 AS (SELECT w.id, '' AS tree, n.p, w.d, w.proof FROM w_{levels} w JOIN named n ON w.tree = n.tree),
{climb('v', 's')}
SELECT l.doc_id, l.leaf, n.subroot, s.d AS root, sha256(v.proof) AS proof_sha256, v.d AS folded_root, v.d = s.d AS verified
FROM leaves l JOIN v_{levels} v USING (id) JOIN named n ON l.tree = n.tree, s_{levels} s"""
