"""Toxic passages: maximal-scoring segments over token log-odds, calibrated by extreme values.

Learning. From at most LABELLED different texts per class (chosen by a hash of the text) each word gives its features: itself and its first 4, 5 and 6
bytes, hashed to 2^FEATURE_BITS cells. A cell counts the documents of either class that hold it. The log-odds ratio of a cell is taken with an
informative Dirichlet prior: PRIOR documents of either class that hold the cell as often as all documents do. A word scores the log-odds of its
most significant cell (largest |z| above SIGNIFICANT), or nothing, less DRIFT.

Scoring. The maximal segments of a text (Ruzzo and Tompa) are its candidate passages. Segments of clean text exceed a high score s at the rate
E(s) = K n e^(-lambda s) for n words: the scores are a random walk with negative drift, whose peaks have an exponential tail. lambda and K are
fitted to the peaks above PEAK of the clean labelled documents. If a text's r-th best segment scores s, the chance of r such segments in clean text
is the Poisson tail P(N >= r | E(s)); the smallest of these over r is its extreme-value p-value, so one strong passage counts as well as
several weaker ones. -log p becomes the probability of label 1 by a logistic curve fitted on the same documents. Passages with E(s) below PASSAGE
are reported as significant by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb
from listingscope.session import cut, discard

LABELLED = 6000          # labelled documents per class that teach: the bound of the sample
FEATURE_BITS = 20        # the model is an array of 2^20 numbers, whatever it learned from
PREFIXES = (4, 5, 6)
PRIOR, SIGNIFICANT, DRIFT = 20.0, 4.0, 0.1
PEAK = 1.0               # peaks that are fitted
PASSAGE = 0.05


@dataclass
class Model:
    odds: np.ndarray       # by cell
    z: np.ndarray
    rate: float            # lambda
    log_k: float
    slope: float
    base: float


def _cells(w: wb.Words) -> np.ndarray:
    """Feature cells of each word: a row per word."""
    columns = [wb.hashes(w.data, w.starts, w.ends)]
    for p in PREFIXES:
        columns.append(wb.mix(wb.hashes(w.data, w.starts, np.minimum(w.ends, w.starts + p)) + np.uint64(p)))
    return (np.stack(columns, axis=1) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def _word_scores(w: wb.Words, model: Model) -> np.ndarray:
    """Each different word of the slice is scored once."""
    _, first, back = np.unique(wb.hashes(w.data, w.starts, w.ends), return_index=True, return_inverse=True)
    lengths = w.ends[first] - w.starts[first]
    ends = np.cumsum(lengths)
    bytes_of = np.repeat(w.starts[first] - (ends - lengths), lengths) + np.arange(lengths.sum())
    cells = _cells(wb.Words(w.data[bytes_of], ends - lengths, ends, w.first))
    best = np.abs(model.z[cells]).argmax(axis=1)
    at = cells[np.arange(len(cells)), best]
    return (np.where(np.abs(model.z[at]) > SIGNIFICANT, model.odds[at], 0.0) - DRIFT)[back]


def segments(scores: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa: all maximal segments (first, end, sum) with at least the given sum, in time linear in the number of scores.

    Every candidate keeps a link to the nearest one before it with a smaller left sum, so no search passes a candidate twice.
    """
    positive = scores > 0
    if least > 0 and scores[positive].sum() < least - 1e-6:
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))   # a run of positive scores is one candidate
    firsts, ends, lefts, totals, links = [], [], [], [], []
    for a, b in edges.reshape(-1, 2).tolist():
        left, total, j = float(sums[a]), float(sums[b]), len(firsts) - 1
        while j >= 0 and lefts[j] >= left:
            j = links[j]
        while j >= 0 and totals[j] < total:    # it grows back to candidate j, whose left sum and link it takes
            a, left, below = firsts[j], lefts[j], links[j]
            del firsts[j:], ends[j:], lefts[j:], totals[j:], links[j:]
            j = below
        firsts.append(a)
        ends.append(b)
        lefts.append(left)
        totals.append(total)
        links.append(j)
    return [(a, b, total - left) for a, b, left, total in zip(firsts, ends, lefts, totals) if total - left >= least]


def _rate(counts: dict[int, int], label: str = "y") -> Column:
    """Share of each class's rows that keeps about LABELLED of them."""
    return F.when(F.col(label) == 1, min(1.0, LABELLED / counts.get(1, 1))).otherwise(min(1.0, LABELLED / counts.get(0, 1)))


def _majority(ones: Column, n: Column) -> Column:
    return (2 * ones >= n).cast("int")


def _sample(labelled: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(t, y): about LABELLED different texts of each class at most, chosen by a hash of the text; counts are those of the different texts."""
    drawn = F.pmod(F.xxhash64("t"), F.lit(1 << 40)) / float(1 << 40)
    some = labelled.where(drawn <= max(min(1.0, LABELLED / n) for n in counts.values()))   # by the text alone: all rows of a text come or none
    texts = some.groupBy(F.xxhash64("t").alias("h"), "t").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n"))
    return texts.select("t", _majority(F.col("ones"), F.col("n")).alias("y")).where(drawn <= _rate(counts))


def choose(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> tuple[DataFrame, float | None]:
    """About LABELLED rows (key, label) per class, chosen by a hash of the key, and the share of label 1 among all; the rows are small enough
    to broadcast, so the texts they name are found without a shuffle of all texts."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.sum(F.col(label).cast("int")).alias("ones"), F.count(F.lit(1)).alias("n"))
    known = marks.select(key, _majority(F.col("ones"), F.col("n")).alias(label))   # a repeated key is one row
    counts = {r[0]: r[1] for r in known.groupBy(label).agg(F.count(F.lit(1))).collect()}  # two rows
    drawn = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    total = sum(counts.values())
    return known.where(drawn <= _rate(counts, label)), counts.get(1, 0) / total if total else None


def learn(labelled: DataFrame, text: str = "text", label: str = "toxic", share_toxic: float | None = None) -> Model:
    """A model from rows with label 0 or 1; rows with a null text or another label teach nothing, and a repeated text teaches once, with the
    label of most of its rows (1 if there are as many of either).

    With one class only, or none, nothing is learned: every text then gets the score of the known share of toxic rows (0.5 for none).
    """
    wb.bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    marks = known.groupBy(F.xxhash64("t").alias("h")).agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n"))
    classes = marks.groupBy(_majority(F.col("ones"), F.col("n")).alias("y")).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect()  # two rows
    total = sum(r.n for r in classes)
    prior = share_toxic if share_toxic is not None else sum(r.ones for r in classes) / total if total else 0.5
    flat = Model(np.zeros(1 << FEATURE_BITS, np.float32), np.zeros(1 << FEATURE_BITS, np.float32), 1.0, 0.0, 0.0, math.log((prior + 1e-3) / (1 - prior + 1e-3)))
    if len(classes) < 2:
        return flat
    sample = cut(_sample(known, {r.y: r.texts for r in classes}))
    counts = np.zeros((2, 1 << FEATURE_BITS))
    n_docs = np.zeros(2)
    for r in sample.mapInArrow(_count, "y int, cell int, n long").groupBy("y", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.cell < 0:
            n_docs[r.y] += r.n
        else:
            counts[r.y, r.cell] += r.n
    held = counts.sum(axis=0)
    alpha = PRIOR * held / n_docs.sum() + 1e-9
    odds = [np.log((counts[y] + alpha) / (n_docs[y] + PRIOR - counts[y] - alpha + 1e-6)) for y in (0, 1)]
    ratio = odds[1] - odds[0]
    z = np.where(held > 0, ratio / np.sqrt(1 / (counts[0] + alpha) + 1 / (counts[1] + alpha)), 0.0)
    flat.odds, flat.z = np.where(held > 0, ratio, 0.0).astype(np.float32), z.astype(np.float32)
    model = _calibrate(flat, sample, prior)
    discard(sample)
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a cell; cell -1 counts the documents."""
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    docs = np.zeros(2, np.int64)
    for batch in batches:
        for part in wb.slices(batch, "t"):
            w = wb.words(part.column("t"), wb.ALPHANUMERIC)
            cells = _cells(w)
            for y, a, b in zip(part.column("y").to_pylist(), w.first[:-1], w.first[1:]):
                counts[y, np.unique(cells[a:b])] += 1
                docs[y] += 1
    y, cell = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((y, [0, 1])).astype(np.int32)), pa.array(np.concatenate((cell, [-1, -1])).astype(np.int32)),
         pa.array(np.concatenate((counts[y, cell], docs)))], ["y", "cell", "n"])


def _calibrate(model: Model, sample: DataFrame, prior: float) -> Model:
    """Fit lambda and K to the peaks of clean documents, then the logistic curve to both classes."""

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch, "t"):
                w = wb.words(part.column("t"), wb.ALPHANUMERIC)
                found = _segments_of(w, model, PEAK)
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), pa.array(np.diff(w.first)), pa.array([len(own) for own in found], pa.int64()),
                     pa.array([math.fsum(s - PEAK for _, _, s in own) for own in found], pa.float64())], ["y", "n", "peaks", "excess"])

    rows = sample.mapInArrow(peaks, "y int, n long, peaks long, excess double").toPandas()  # about 2 * LABELLED rows of four numbers
    clean = rows[rows.y == 0]
    found = int(clean.peaks.sum())
    # The exponential tail's likelihood has its maximum at 1 / mean excess; one more peak keeps an empty tail finite.
    model.rate = (found + 1) / (math.fsum(clean.excess) + 1.0)
    model.log_k = math.log((found + 1) / max(1, clean.n.sum())) + model.rate * PEAK

    def surprises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch, "t"):
                w = wb.words(part.column("t"), wb.ALPHANUMERIC)
                x = [_surprise(model, n, _ranked(own)) for n, own in zip(np.diff(w.first).tolist(), _segments_of(w, model, PEAK))]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(x, pa.float64())], ["y", "x"])

    rows = sample.mapInArrow(surprises, "y int, x double").toPandas().sort_values(["y", "x"])  # about 2 * LABELLED rows of two numbers
    x, y = rows.x.to_numpy(), rows.y.to_numpy()
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    model.slope, model.base = _logistic(x, y, weight / weight.sum())
    return model


def _segments_of(w: wb.Words, model: Model, least: float) -> list[list[tuple[int, int, float]]]:
    scores = _word_scores(w, model)
    return [segments(scores[a:b], least) for a, b in zip(w.first[:-1], w.first[1:])]


def _ranked(own: list[tuple[int, int, float]]) -> list[float]:
    return sorted((s for _, _, s in own), reverse=True)


def _surprise(model: Model, n: int, best) -> float:
    """-log of the smallest Poisson tail over the ranks of the segment sums, which descend."""
    most = 0.0
    for r, s in enumerate(best, 1):
        rate = math.exp(min(0.0, _log_expected(model, n, s)) if r == 1 else min(50.0, _log_expected(model, n, s)))
        if rate < r:
            # P(N >= r) lies between its first term and that over 1 - rate / (r + 1).
            log_p = r * math.log(max(rate, 1e-300)) - rate - math.lgamma(r + 1) - math.log(1 - rate / (r + 1))
            most = max(most, -log_p)
    return min(most, 300.0)


def _log_expected(model: Model, n: int, s: float) -> float:
    """Logarithm of the number of segments of clean text with n words that score s or more."""
    return model.log_k + math.log(max(n, 1)) - model.rate * s


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number, by Newton steps with a little shrinkage."""
    beta = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 1e-4 * beta * np.array([1, 0])
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, surprise, passages) for every row; surprise is -log p, passages are (first word, words, sum) of every significant segment.

    Null, empty and wordless texts have the score of a text without any toxic word and no passages. Equal texts get equal scores. Only the text
    is read. The model is broadcast: 8 MB, whatever it learned from.
    """
    spark = docs.sparkSession
    wb.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    passage = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType()), T.StructField("sum", T.DoubleType())]))
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("surprise", T.DoubleType()), T.StructField("passages", passage)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in wb.slices(batch, "t"):
                w = wb.words(part.column("t"), wb.ALPHANUMERIC)
                surprise, found = [], []
                for n, own in zip(np.diff(w.first).tolist(), _segments_of(w, m, PEAK)):
                    surprise.append(_surprise(m, n, _ranked(own)))
                    found.append([{"first": a, "words": b - a, "sum": s} for a, b, s in own if _log_expected(m, n, s) < math.log(PASSAGE)])
                chance = 1 / (1 + np.exp(-np.clip(m.base + m.slope * np.array(surprise), -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(chance), pa.array(surprise), pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("sum", pa.float64())])))],
                    ["id", "score", "surprise", "passages"])

    out = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(key), "score", "surprise", "passages")
