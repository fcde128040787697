"""Labelled training rows and the small logistic fits that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import smallest

#: Labelled documents that a classifier is fitted on at most: those with the smallest hash of the doc_id.
FIT_ROWS = 20_000


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def fit_labels(labels: DataFrame, column: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, label) of at most FIT_ROWS rows that are not held out; null, other and conflicting labels don't count."""
    one = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_most")).where("label = _most")
    return smallest(one.select("doc_id", F.col("label").cast("int").alias("label")), "doc_id", FIT_ROWS)


def logistic(x: np.ndarray, y: np.ndarray, l2: float, weight: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression without intercept, by damped Newton steps; ridge ``l2`` on the mean loss."""
    n, k = x.shape
    w, c = np.zeros(k), np.ones(n) if weight is None else weight
    c = c / c.sum()

    def loss(w: np.ndarray) -> float:
        return float(c @ np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)) + l2 / 2 * w @ w)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (c * (p - y)) + l2 * w
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + (l2 + 1e-9) * np.eye(k), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-10:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the scores at which cutting gives the best mean of both classes' accuracy and the whole accuracy."""
    order = np.argsort(score, kind="stable")
    s, t = score[order], y[order]
    below0, below1 = np.cumsum(t == 0), np.cumsum(t == 1)
    n0, n1 = max(1, below0[-1]), max(1, below1[-1])
    balanced = (below0 / n0 + (n1 - below1) / n1) / 2
    accurate = (below0 + n1 - below1) / len(t)
    value = balanced + accurate
    value[:-1][s[:-1] == s[1:]] = -1
    at = int(np.argmax(value[:-1])) if len(s) > 1 else 0
    return float((s[at] + s[min(at + 1, len(s) - 1)]) / 2)
