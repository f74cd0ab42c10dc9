"""Quality rules: counted base rules, and a hashed n-gram logistic regression against a fixed threshold.

Words, word pairs and character trigrams are hashed into blocks of weights; a document's logit is the
bias plus the mean weight of its n-grams in each block. The weights are fitted on a bounded sample of
labelled rows, then calibrated to probabilities (a logistic curve on rows kept apart) and scored in
Arrow batches. Null and empty texts have no words and fail the base rules. An unlabelled or one-sided
corpus gives the constant probability of its labels (1 without labels), so nothing is rejected by it.
Rows are judged one by one, so repeated ones alike; very long texts are handled whole. A probability equal to the
threshold is kept; rows are sorted before a fit, so reruns agree. An empty table gives no rows. Other columns
than id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat_bytes, map_arrow
from .labelled import labelled_sample
from .text_kernel import U, mix, text_stats, windows

BITS = 12
SIZE = 1 << BITS
#: Labelled rows that a fit may use; a bounded sample by id hash.
SAMPLE_ROWS = 3000
#: Smallest calibrated probability of a good document that is kept.
THRESHOLD = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SLICE = 512 << 10
_SHIFT = U(64 - BITS)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every character trigram."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    inside = row[2:] == row[:-2]
    return (h[inside] >> np.uint32(32 - BITS)).astype(np.int64), row[:-2][inside]


def grams(texts: list[str], stats: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the n-grams of the three blocks."""
    words, first = stats["word_hashes"], stats["first_word"]
    row = np.repeat(np.arange(len(texts)), stats["words"])
    pairs, prow = windows(words, first, 2)
    return [((mix(words) >> _SHIFT).astype(np.int64), row), ((pairs >> _SHIFT).astype(np.int64), prow), trigrams(texts)]


@dataclass
class Model:
    weights: np.ndarray  # blocks x SIZE
    bias: float
    slope: float
    offset: float

    def logit(self, texts: list[str], stats: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for block, (bucket, row) in enumerate(grams(texts, stats)):
            n = np.bincount(row, minlength=len(texts))
            out += np.bincount(row, weights=self.weights[block][bucket], minlength=len(texts)) / np.maximum(n, 1)
        return out

    def probability(self, texts: list[str], stats: dict[str, np.ndarray]) -> np.ndarray:
        return sigmoid(self.slope * self.logit(texts, stats) + self.offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def sparse_rows(docs: DataFrame) -> DataFrame:
    """y, and the packed bucket numbers and shares of each document's n-grams."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        found = grams(texts, text_stats(*flat_bytes(batch.column(0))))
        buckets, shares = [], []
        cells = []
        for block, (bucket, row) in enumerate(found):
            cell, n = np.unique(row.astype(np.int64) * SIZE + bucket, return_counts=True)
            total = np.bincount(row, minlength=len(texts))
            cells.append((cell // SIZE, cell % SIZE + block * SIZE, n / total[cell // SIZE]))
        row, bucket, share = (np.concatenate(x) for x in zip(*cells))
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(texts) + 1))
        bucket, share = bucket[order].astype("<u2"), share[order].astype("<f4")
        for a, b in zip(cuts, cuts[1:]):
            buckets.append(bucket[a:b].tobytes())
            shares.append(share[a:b].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], names=["y", "buckets", "shares"])

    return map_arrow(docs.select("text", "y"), kernel, "y int, buckets binary, shares binary", "text", SLICE)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = 120, l2: float = 1e-5) -> Model:
    """Fits weights on three quarters of the sample and the calibration on the rest."""
    rows = sparse_rows(labelled_sample(docs, labels, sample_rows)).orderBy("y", "buckets", "shares").collect()
    y = np.array([r.y for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((3, SIZE)), 60.0 if not len(y) or y[0] else -60.0, 1.0, 0.0)
    bucket = [np.frombuffer(r.buckets, dtype="<u2") for r in rows]
    size = np.array([len(b) for b in bucket])
    bucket, share = np.concatenate(bucket).astype(np.int64), np.concatenate([np.frombuffer(r.shares, dtype="<f4") for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    apart = np.arange(len(rows)) % 4 == 3
    scale = np.sqrt(np.bincount(bucket, weights=share.astype(np.float64) ** 2, minlength=3 * SIZE) / len(rows)) + 1e-4
    value = share / scale[bucket]
    weight = (~apart).astype(np.float64)
    w, bias = np.zeros(3 * SIZE), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        score = bias + np.bincount(row, weights=w[bucket] * value, minlength=len(rows))
        error = (sigmoid(score) - y) * weight / weight.sum()
        g = np.bincount(bucket, weights=error[row] * value, minlength=3 * SIZE) + l2 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        bias -= 0.02 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    score = bias + np.bincount(row, weights=w[bucket] * value, minlength=len(rows))
    slope, offset = calibrate(score[apart], y[apart])
    return Model((w / scale).reshape(3, SIZE), bias, slope, offset)


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from scores to labels, by Newton steps with smoothed targets."""
    if not len(y):
        return 1.0, 0.0
    good = y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * score + b)
        d, h = target - p, p * (1 - p)
        g = np.array([(d * score).sum() - 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.05), float(b)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict, probability and final verdict of every document."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        s = text_stats(*flat_bytes(batch.column(1)))
        p = model.probability(texts, s)
        failed = (s["words"] < MIN_WORDS) | (100 * s["repeat_words"] > MAX_REPEAT_PERCENT * s["words"])
        longs = [pa.array(s[c], pa.int64()) for c in ("words", "word_chars", "symbol", "dup_lines", "repeat_words")]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *longs, pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)],
            names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
        )

    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), kernel, schema, "text", SLICE).withColumnRenamed("id", id_col)
