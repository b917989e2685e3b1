"""Quality by supervised subword embeddings.

A document's features are its words, its word pairs and the byte n-grams of its words (white space marks a word's
edges), hashed into ``2**bits`` buckets. A pair is hashed by the difference of its words' hashes, so that all
immediate repeats share a bucket. Each bucket has a learned vector; a document is the average of its features' vectors, and a softmax
layer over it gives the class probabilities. Trained by stochastic gradient descent in numpy.

Scoring: the layer is linear in the average, so a bucket's vector times the layer's weights is one number; these are
rounded to fixed point and added as integers, which makes a score the same however rows are batched.

Scale: at most ``train_rows`` labelled texts reach the driver; scoring is one map over the scan, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, bucket_of, text_of

BITS = 18
DIM = 8
GRAMS = (3, 4)
TRAIN_ROWS = 4000
EPOCHS = 4
RATE = 4.0
FIXED = 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 19  # bytes scored at once: their arrays take about 100 bytes a byte


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * MULT) >> np.uint64(64 - bits)).astype(np.int32)


def features(raw: bytes, firsts: np.ndarray | None = None, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) for the words, the word pairs, then each length of n-gram, of a buffer of UTF-8 bytes.

    A pair stands at its second word. ``firsts``: where texts start in the buffer; no pair crosses these.
    """
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return []
    space = (b == 32) | ((b >= 9) & (b <= 13))
    v = np.where(space, np.uint8(32), b).astype(np.uint64)
    powers = np.cumprod(np.full(len(b) + 1, 0x100000001B3, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * powers[:-1])])
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    inverse = np.uint64(pow(0x100000001B3, -1, 1 << 64))
    back = np.cumprod(np.full(len(b) + 1, inverse, np.uint64))
    words = (sums[end] - sums[start]) * back[start]
    out = [(start, _buckets(words + np.uint64(1), bits))]
    if firsts is not None:
        inner = np.ones(len(start), bool)
        inner[np.searchsorted(start, firsts[firsts <= start[-1]] if len(start) else firsts[:0])] = False
    else:
        inner = np.arange(len(start)) > 0
    second = np.flatnonzero(inner)
    out.append((start[second], _buckets((words[second] - words[second - 1]) * np.uint64(3) + np.uint64(2), bits)))
    for n in GRAMS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint64)
        inside = np.zeros(len(h), bool)
        for k in range(n):
            h = h * np.uint64(0x01000193) + v[k : len(b) - n + 1 + k]
            if 0 < k < n - 1:
                inside |= space[k : len(b) - n + 1 + k]
        at = np.flatnonzero(~inside)
        out.append((at, _buckets(h[at], bits)))
    return out


def _averaged(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = features(b"\n" + raw + b"\n")
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, n = np.unique(np.concatenate([f[1] for f in found]), return_counts=True)
    return at.astype(np.int32), (n / n.sum()).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """The weight of every bucket for class 1 against class 0, and the bias, in fixed point (FIXED is one)."""
    good = sum(1 for y in labels if y == 1)
    if not labels or good in (0, len(labels)):
        bias = 0.0 if not labels else (4.0 if good else -4.0)
        return np.zeros(1 << BITS, np.int64), bias
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    layer[:, 1] = rng.uniform(-1, 1, DIM)
    rows = [_averaged(t.encode()) for t in texts]
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, share = rows[i]
            mean = share @ vectors[at]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i] == 1)] -= 1
            back = layer @ p
            layer -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            vectors[at] -= rate * 10 * share[:, None] * back
    return np.round(vectors @ (layer[:, 1] - layer[:, 0]) * FIXED).astype(np.int64), float(bias[1] - bias[0])


def score_texts(raws: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of class 1 for each text; texts are scored together, piece by piece."""
    sums, counts = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
    first = 0
    while first < len(raws):
        last, size = first, 0
        while last < len(raws) and (size == 0 or size + len(raws[last]) < PIECE):
            size += len(raws[last]) + 1
            last += 1
        starts = np.cumsum([1] + [len(r) + 1 for r in raws[first : last - 1]])
        for at, bucket in features(b"\n" + b"\n".join(raws[first:last]) + b"\n", starts):
            # every text stands between line feeds, which are its first and last word's edges wherever it is scored
            doc = np.searchsorted(starts, at + 1, side="right") - 1
            np.add.at(counts, slice(first, last), np.bincount(doc, minlength=last - first))
            cut = np.searchsorted(doc, np.arange(last - first))
            total = np.concatenate([[0], np.cumsum(weights[bucket])])
            sums[first:last] += total[np.append(cut[1:], len(doc))] - total[cut]
        first = last
    return 1 / (1 + np.exp(-(sums / FIXED / np.maximum(counts, 1) + bias)))


def add_quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    held_out: tuple[int, int] = (3, 1),
    train_rows: int = TRAIN_ROWS,
    score_col: str = "_quality",
) -> DataFrame:
    """The input's rows with ``score_col`` behind all their columns; see ``quality_score``. The name must be free.

    Of a training id that stands on several rows the least text is learned from, once, so at most ``train_rows`` texts
    come to the driver.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    out = bucket_of("doc_id", held_out[0]) == held_out[1]
    known = labels.select(F.col("doc_id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~out)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    ids = rows.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y"))  # train_rows rows at most
    sample = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    sample = sample.toPandas().sort_values("doc_id")
    weights, bias = train(sample["text"].tolist(), [int(y) for y in sample["y"]])
    model = df.sparkSession.sparkContext.broadcast(weights)

    def make():
        def score(batch):
            return [pa.array(score_texts([(t or "").encode() for t in batch.column(text_col).to_pylist()], model.value, bias))]

        return score

    return append_columns(df, f"`{score_col}` double", make)


def quality_score(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] = (3, 1), **settings
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from at most ``train_rows`` labelled ids (the lowest by hash) whose crc32 mod held_out[0] is not
    held_out[1]; ``labels`` has doc_id and ``label_col``. A null text is scored as the empty text, which has the bias
    alone. Repeated labels of an id count once, by the lowest; null labels are left out. With no labels every score is
    0.5; with one class only, near that class.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    out = bucket_of("doc_id", held_out[0]) == held_out[1]
    told = add_quality(rows, labels, "doc_id", "text", label_col, held_out, **settings)
    return told.select("doc_id", out.alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= 0.5).cast("int").alias("predicted"))
