"""Quality classifier: Naive Bayes support vectors over n-gram indicators (operator 4)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .anchors import mix, word_hashes
from .common import as_bytes, small
from .toxicity import TRAIN_ROWS, held_out, training_rows

#: Hashed indicators.
FEATURES = 1 << 18

# Byte classes of shapes: lower, upper, digit, space, line end, beyond ASCII, and each mark by itself modulo ten.
_SHAPE = np.array([4 if b == 10 else 3 if b in (9, 11, 12, 13, 32) else 2 if 48 <= b < 58 else 1 if 65 <= b < 91 else 0 if 97 <= b < 123 else 5 if b >= 128 else 6 + b % 10 for b in range(256)], np.uint8)


def _grams(codes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(codes) - n + 1, salt, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j].astype(np.uint64) + np.uint64(1)
    return mix(h)


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the features it has: words and word pairs, shape n-grams, runs of repeated words, and binned shares."""
    words, starts = word_hashes(texts)
    out = []
    for i, text in enumerate(texts):
        w = words[starts[i] : starts[i + 1]]
        shape = _SHAPE[np.frombuffer(text, np.uint8)]
        runs = shape[np.flatnonzero(np.diff(shape, prepend=255))] if len(shape) else shape
        # how far back a word was last seen, up to 3: repetition as a sequence
        back = np.zeros(len(w), np.int64)
        for d in (3, 2, 1):
            if len(w) > d:
                back[d:][w[d:] == w[:-d]] = d
        counts = np.bincount(shape, minlength=16) / max(1, len(shape))
        distinct = len(np.unique(w)) / max(1, len(w))
        ends = np.bincount(runs, minlength=16)
        shares = [*counts, distinct, (back == 1).mean() if len(w) else 0, (back > 0).mean() if len(w) else 0, ends[6:].sum() / max(1, len(w)), ends[4] / max(1, len(w)), counts[6:].sum()]
        bins = [j * 64 + int(min(31, 2 * math.log2(1 + 1000 * s))) for j, s in enumerate(shares)]
        bins += [40 * 64 + int(math.log2(1 + len(w))), 41 * 64 + int(min(31, len(text) / max(1, len(w))))]
        grams = [_grams(w, 1, 1), _grams(w, 2, 2), *(_grams(runs, n, 10 + n) for n in (1, 2, 3, 4, 5)), *(_grams(back, n, 20 + n) for n in (1, 2, 3, 4)), mix(np.array(bins, np.uint64) + np.uint64(77))]
        out.append(np.unique((np.concatenate(grams) % np.uint64(FEATURES)).astype(np.int64)))
    return out


def descend(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent on the hinge loss over scaled indicators: weights, intercept and the dual variables, each between 0 and its row's cost.

    A row's indicators are scaled by the class ratio and the root of their number; each class costs the same in all.
    """
    n = len(x)
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(n)
    scaled = [ratio[f] / math.sqrt(max(1, len(f))) for f in x]
    norm = [float(v @ v) + 1.0 for v in scaled]
    cost = [c * n / (2 * max(1, (y == t).sum())) * 20 for t in y]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(n):
            s = 1.0 if y[i] else -1.0
            gradient = s * (float(w[x[i]] @ scaled[i]) + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[x[i]] += step * scaled[i]
                b += step
                alpha[i] = new
    return w, b, alpha


def fit(texts: list[bytes], labels: list[int], c: float = 0.1, epochs: int = 12, seed: int = 1) -> dict:
    """Scale indicators by class log-count ratios, then hinge loss by dual coordinate descent; scores by a logistic fit of margins."""
    y = np.array(labels, float)
    if not len(y) or len(set(labels)) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1)
        return {"w": np.zeros(FEATURES, np.float32), "b": 0.0, "scale": (0.0, math.log(p / (1 - p)))}
    x = indicators(texts)
    pos, neg = np.ones(FEATURES), np.ones(FEATURES)
    for f, t in zip(x, labels):
        (pos if t else neg)[f] += 1
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))

    def margins(w: np.ndarray, b: float, rows) -> np.ndarray:
        return np.array([float((w[x[i]] * ratio[x[i]]).sum()) / math.sqrt(max(1, len(x[i]))) + b for i in rows])

    rows = np.arange(len(x))
    # The logistic scale comes from rows that a first fit has not seen.
    away = rows % 4 == 0
    w, b, _ = descend([x[i] for i in rows[~away]], y[~away], ratio, c, epochs, seed) if len(set(y[~away])) == 2 else (np.zeros(FEATURES), 0.0, None)
    m, t = margins(w, b, rows[away]), y[away]
    a0, a1 = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a0 * m + a1, -30, 30)))
        a0 -= 0.5 * (float(((p - t) * m).mean()) / max(1e-9, float((m * m).mean())) * 4 + 1e-3 * a0)
        a1 -= 0.5 * float((p - t).mean()) * 4
    w, b, _ = descend(x, y, ratio, c, epochs, seed)
    return {"w": (w * ratio).astype(np.float32), "b": float(b), "scale": (max(0.1, float(a0)), float(a1))}


def score_quality(docs: DataFrame, model: dict, text: str = "text", score: str = "quality") -> DataFrame:
    """docs with a column `score` from 0 to 1 added, which docs mustn't have."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats, 1 MB

    def run(batches):
        model = weights.value
        w, b, (a0, a1) = model["w"], model["b"], model["scale"]
        for batch in small(batches):
            found = indicators(as_bytes(batch.column(text)))
            z = np.array([float(w[f].sum()) / math.sqrt(max(1, len(f))) + b for f in found], float)
            values = 1 / (1 + np.exp(-np.clip(a0 * z + a1, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score, DoubleType()))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Score whole texts for quality, learned from `labels` (doc_id, quality).

    Training uses at most TRAIN_ROWS labelled rows (of TRAIN_BYTES of text), none with crc32(id) mod 4 = 2. With no labels, or of one class, every score is the
    smoothed share of class 1. Null texts are empty; null ids are kept (not held out); repeated rows are scored each; an empty table gives
    none; other columns are ignored.

    Returns doc_id, held_out, score, predicted (1 if score >= threshold).
    """
    rows = training_rows(docs, labels, "quality", text, doc_id, TRAIN_ROWS)
    model = fit([t.encode() for _, t, _ in rows], [y for _, _, y in rows])
    scored = score_quality(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text_")), model, "text_")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= threshold).cast("int").alias("predicted"))
