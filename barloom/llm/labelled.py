"""Bounded samples of labelled texts, and small numpy models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` texts of label 0 and of label 1, in hash order.

    Returns ``doc_id, text, y`` and the number of labelled rows of each class.
    Null and contradictory labels are left out; of the texts of a repeated id the one with
    the smallest hash is taken.  The bound makes the ids small
    enough to broadcast; everything but the fit covers all rows.
    """
    clean = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"))
    totals = {r.y: r.n for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = clean.where("y = 0").orderBy(*order).limit(per_class).unionByName(clean.where("y = 1").orderBy(*order).limit(per_class))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")
    )
    # a few tasks, since each sends a partial sum of fixed size to the driver
    return written(sample, "labelled").coalesce(8), totals


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_weights(y: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights that give a class-balanced sample the classes' true shares."""
    n = np.maximum(np.bincount(y, minlength=2), 1)
    share = np.array([totals.get(0, 0), totals.get(1, 0)], float) / max(1, sum(totals.values()))
    return share[y] / n[y]


def adam(params: list[np.ndarray], grads, steps: int, rate: float) -> list[np.ndarray]:
    """Full-batch Adam; ``grads(params)`` gives a gradient for each."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for i, g in enumerate(grads(params)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params


def scale_and_shift(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, slope_only: bool = False) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * logit + offset) fit y best.

    Newton's steps on the weighted log loss, with a small ridge towards 1, 0.
    """
    a, b = 1.0, 0.0
    w = weight / weight.sum()
    for _ in range(50):
        p = sigmoid(a * logit + b)
        g = np.array([(w * (p - y) * logit).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-3 * b])
        q = w * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * logit * logit).sum() + 1e-3, (q * logit).sum()], [(q * logit).sum(), q.sum() + 1e-3]])
        step = np.array([g[0] / h[0, 0], 0.0]) if slope_only else np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -1, 1)
        a = max(a, 0.05)
    return float(a), float(b)
