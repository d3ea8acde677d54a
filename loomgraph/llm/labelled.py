"""Labelled documents to train on, and logistic functions fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 5. Fold 0 is held out; fold 4 calibrates; the others train."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label and fold of all labelled ids outside fold 0. Ids with null or contradicting labels are left out."""
    one = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z"))
    return one.filter("y = z and doc_id is not null").select("doc_id", F.col("y").cast("int").alias("y"), fold().cast("int").alias("fold")).filter("fold <> 0")


def sampled(labels: DataFrame, label: str, most: int) -> DataFrame:
    """Of each class at most ``most`` of the labelled ids, those with the smallest id hash: 2 * most rows at most, whatever the input."""
    one = labelled(labels, label)
    pick = lambda y: one.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick(0).union(pick(1))


def logistic_of(table: DataFrame, inputs: list[str], weight: Column, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """``logistic`` on the rows of a table (the inputs and y): the driver sees the sums of a Newton step, a row a round."""
    x = [*(F.col(c) for c in inputs), F.lit(1.0)]
    n = len(x)
    w = np.zeros(n)
    for _ in range(rounds):
        linear = sum((float(a) * c for a, c in zip(w, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear))))
        slope, miss = weight * p * (1 - p), weight * (F.col("y") - p)
        got = table.agg(*(F.sum(slope * x[i] * x[j]) for i in range(n) for j in range(n)), *(F.sum(miss * c) for c in x)).first()
        h = np.array(got[: n * n], float).reshape(n, n) + ridge * np.eye(n)
        step = np.linalg.solve(h, np.array(got[n * n :], float) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
