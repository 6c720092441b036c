"""Small models shared by the two classifiers: sampling of labelled rows and fitted scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents a classifier is fitted on at most, taken in the order of a hash of their ids.
LABELLED_ROWS = 20_000


def fold(modulus: int):
    """crc32 of the id as text, modulo ``modulus``; the id's null stays null."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(labels: DataFrame, column: str, train, rows: int = LABELLED_ROWS) -> DataFrame:
    """Up to ``rows`` labelled ids with their label as ``y``; conflicting rows of an id are averaged.

    ``train`` is a condition on doc_id. The bound makes the result small enough to broadcast.
    """
    return (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(train)
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(rows)
    )


def standardised(x: np.ndarray):
    centre, scale = x.mean(0), x.std(0)
    return centre, np.where(scale > 1e-9, scale, 1.0)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam from zero weights; ``gradient(w)`` returns the gradient at ``w``."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def newton(at, w: np.ndarray, steps: int = 60) -> np.ndarray:
    """Minimise a convex function from ``w``; ``at(w)`` returns its value, gradient and curvature.

    A step is halved until the value falls. The last one is small and isn't evaluated.
    """
    value, gradient, curve = at(w)
    for _ in range(steps):
        step = np.linalg.solve(curve, gradient)
        fall = gradient @ step
        if fall < 1e-8:
            return w - step
        while (got := at(w - step))[0] > value - 1e-4 * fall and fall > 1e-8:
            step, fall = step / 2, fall / 2
        w, (value, gradient, curve) = w - step, got
    return w


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The score from which calling rows positive gives the best F1; 0.5 without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    last = np.append(s[1:] != s[:-1], True)  # equal scores are cut together
    k = int(np.argmax(np.where(last, f1, -1)))
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float(np.clip((s[k] + below) / 2, 1e-6, 1 - 1e-6))


def placed(score: np.ndarray, cut: float, at: float) -> np.ndarray:
    """A rising map of scores that moves ``cut`` to ``at`` and keeps 0 and 1."""
    return np.where(
        score < cut, score * (at / cut), 1 - (1 - score) * ((1 - at) / (1 - cut))
    )
