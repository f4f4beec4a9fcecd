"""Linear models on bounded samples: hinge loss by dual coordinate descent, and calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.operators.sizing import fits_broadcast


def hinge_weights(
    rows: Sequence[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = 1.0, epochs: int = 15
) -> np.ndarray:
    """Weights of a support vector machine over sparse rows (indices, values), by dual coordinate
    descent; each row's bound is weighted so that both classes count alike."""
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    share = np.array([(signs == s).sum() for s in signs], float)
    bound = cost * len(rows) / (2 * np.maximum(share, 1))
    norm = np.array([float(v @ v) for _, v in rows])
    random = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            if not norm[i]:
                continue
            index, value = rows[i]
            gradient = signs[i] * (weights[index] @ value) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                weights[index] += (new - alpha[i]) * signs[i] * value
                moved = max(moved, abs(new - alpha[i]) * norm[i] ** 0.5)
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


def calibrated(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities (Platt, smoothed targets)."""
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, intercept = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(steps):
        p = sigmoid(slope * margins + intercept)
        g = np.array([((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(abs(step).max(), 1e-12))
        slope, intercept = slope - scale * step[0], intercept - scale * step[1]
        if abs(step).max() < 1e-8:
            break
    return float(slope), float(intercept)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out(parts: int, part: int) -> Column:
    """Whether the checksum of the doc_id as text falls in the part that learning never sees."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % parts == part
    return F.coalesce(remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, outside: Column) -> DataFrame:
    """Texts with a label of 0 or 1 that may be learned from, one label a doc_id (the larger).

    ``_pick`` only decides which rows a sample takes: copies of a text under several ids are taken
    one by one, so that the bound of a sample holds for them too."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    if fits_broadcast(known):
        known = F.broadcast(known)
    kept = docs.select("doc_id", "text").filter(~outside).join(known, "doc_id")
    return kept.select("text", "_label", F.xxhash64("text", "doc_id").alias("_pick"))


def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """At most about ``most`` of ``n`` rows, chosen by a hash of ``_pick``, or of their text without one."""
    if n <= most:
        return rows
    pick = F.col("_pick") if "_pick" in rows.columns else F.xxhash64(F.coalesce("text", F.lit("")))
    place = F.pmod(F.xxhash64(pick, F.lit(11)), F.lit(1 << 30))
    return rows.filter(place < int((1 << 30) * most / n))
