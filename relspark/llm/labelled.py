"""Joining documents with labels, and one-dimensional calibration from histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels (about 20 bytes each) up to which their join asks for a broadcast; beyond it Spark shuffles.
MAX_BROADCAST_LABELS = 2_000_000
#: Bins of a score histogram.
BINS = 2048


def fold(doc_id: Column, folds: int, held: int) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``held``; true for a null doc_id, which is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """``text, y int`` of the rows to learn from: labelled 0 or 1 and outside the held-out fold.

    Repeated labels of a document count as the largest; null labels and ids are left out.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~fold(F.col("doc_id"), folds, held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    if labels.count() <= MAX_BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("text", "y")


def histogram(scores: DataFrame, low: float, high: float) -> np.ndarray:
    """Counts (2, BINS) of ``scores(s double, y int)`` between ``low`` and ``high``; what lies outside goes to the end bins."""
    bin_ = F.least(F.greatest(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    out = np.zeros((2, BINS))
    for r in scores.groupBy(bin_.alias("bin"), "y").count().collect():
        out[r.y, r.bin] += r["count"]
    return out


def platt(counts: np.ndarray, at: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit to class counts at the points ``at``, with Platt's softened targets."""
    n0, n1 = counts.sum(axis=1)
    if not n0 or not n1:
        return 0.0, float(np.log((n1 + 0.5) / (n0 + 0.5)))
    x, w = np.concatenate([at, at]), np.concatenate([counts[0], counts[1]])
    target = np.concatenate([np.full(len(at), 1 / (n0 + 2)), np.full(len(at), (n1 + 1) / (n1 + 2))])
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h, g = w * np.maximum(p * (1 - p), 1e-9), w * (target - p)
        m = np.array([[np.sum(h * x * x) + 1e-6, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-6]])
        step = np.linalg.solve(m, [np.sum(g * x), np.sum(g)])
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 0.0), b


def isotonic(counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points and values of a rising fit to the share of class 1 in each bin (pooling adjacent violators)."""
    blocks: list[list[float]] = []  # weight, class 1, sum of weighted points
    for n0, n1, x in zip(counts[0], counts[1], at, strict=True):
        if n0 + n1:
            blocks.append([n0 + n1, n1, x * (n0 + n1)])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])
