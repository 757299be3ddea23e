"""Words of whole Arrow text columns as byte positions and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20   # text handed to NumPy at once; a longer text makes a slice of its own
CHUNK_BYTES = 1 << 18   # bytes hashed at once
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _random_words(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed | 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=np.uint64)


_BYTE = _random_words(256, 0xD1B54A32D192ED03)
_UP, _DOWN = _powers(_BASE, CHUNK_BYTES), _powers(_INVERSE, CHUNK_BYTES)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` hold for bytes of UTF-8 as they do for characters.
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Words:
    """Lower-cased bytes of a column of texts and its words ``data[starts[i]:ends[i]]``; text d has the words first[d]:first[d+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers stay small in bytes as well as rows: one batch of very long texts must fit a worker."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most SLICE_BYTES of text, or one row."""
    ends = np.cumsum(text_bytes(batch.column(column)))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_bytes(texts: pa.Array) -> np.ndarray:
    """UTF-8 length of each text; 0 for null."""
    return np.diff(_bytes(texts)[1]) if len(texts) else np.empty(0, np.int64)


def words(texts: pa.Array, kind: np.ndarray) -> Words:
    """Null has no words."""
    raw, offsets = _bytes(texts)
    data = LOWER[raw]
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; starts ascend and stretches may share bytes only within CHUNK_BYTES."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            a = int(starts[at])
            to = max(at + 1, int(np.searchsorted(starts, a + CHUNK_BYTES // 2, "left")))
            while to > at + 1 and int(ends[at:to].max()) - a > CHUNK_BYTES:
                to = at + (to - at) // 2
            b = int(ends[at:to].max())
            up, down = (_UP, _DOWN) if b - a <= CHUNK_BYTES else (_powers(_BASE, b - a), _DOWN)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[data[a:b]] * up[:b - a], out=sums[1:])
            s, e = starts[at:to] - a, ends[at:to] - a
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def runs(hashed: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, at the first of them."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, power in enumerate(_powers(0xA24BAED4963EE407, k)):
            out += hashed[j:j + n] * power
    return mix(out)


def whole(hashed: np.ndarray) -> int:
    """A hash of all words given and their number."""
    with np.errstate(over="ignore"):
        total = (hashed * _powers(0xA24BAED4963EE407, len(hashed))).sum(dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(hashed)) * np.uint64(0x9FB21C651E98DF25)], np.uint64))[0])

