"""Labelled samples and folds shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows_per_label: int | dict[int, int],
           id_col: str = "doc_id") -> DataFrame:
    """At most ``rows_per_label`` (one bound, or one for each label) labelled
    documents of each label, in hash order: a bounded sample for fitting, nothing else.

    ``learn`` filters by the id. The ids are chosen from the labels alone, so
    the broadcast side has at most ``rows_per_label`` rows of each label and no text
    but the sample's is moved; repeated rows of a document count to the bound.
    """
    y = labels.filter(learn).select(F.col(id_col).alias("__i"), F.col(label).cast("int").alias("__y")) \
        .filter("__i IS NOT NULL AND __y IN (0, 1)").distinct()
    order = [F.xxhash64("__i", F.lit("fit")), F.col("__i")]
    bound = rows_per_label if isinstance(rows_per_label, dict) else {0: rows_per_label, 1: rows_per_label}
    chosen = [y.filter(F.col("__y") == v).orderBy(*order).limit(bound[v]) for v in (0, 1)]
    joined = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), docs[id_col] == F.col("__i"))
    parts = [joined.filter(F.col("__y") == v).orderBy(*order).limit(bound[v]) for v in (0, 1)]
    return parts[0].unionByName(parts[1]).drop("__i")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
