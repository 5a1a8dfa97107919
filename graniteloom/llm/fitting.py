"""Small models fitted on the driver from bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds is fold; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample_ids(labels: DataFrame, label: str, most: int, seed: int) -> DataFrame:
    """At most `most` labelled rows of each class (0 and 1), those with the lowest seeded hashes: (_id, _label).

    The bound holds whatever the input, so the result may be broadcast.
    """
    picked = []
    for value in (0, 1):
        rows = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        picked.append(rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), F.lit(value).alias("_label")))
    return picked[0].unionByName(picked[1])


def expanded(x: np.ndarray) -> np.ndarray:
    """Features with their squares and products."""
    n = x.shape[1]
    return np.hstack([x, *(x[:, [i]] * x[:, [j]] for i in range(n) for j in range(i, n))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> dict[str, np.ndarray]:
    """Logistic regression on standardised quadratic features, by Newton steps. With one class only, or no features,
    the model is the constant (n1 + 1) / (n + 2)."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    wide = expanded(x) if len(x) else np.zeros((0, 0))
    if len(x) == 0 or y.min() == y.max():
        return {"mean": np.zeros(0), "scale": np.ones(0), "w": np.array([np.log(prior / (1 - prior))])}
    mean, scale = wide.mean(0), wide.std(0) + 1e-9
    z = np.hstack([np.ones((len(y), 1)), np.clip((wide - mean) / scale, -8, 8)])
    penalty = np.full(z.shape[1], ridge * len(y) / 100)
    penalty[0] = 0
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "w": w}


def logistic(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores strictly between 0 and 1."""
    if len(model["mean"]) == 0:
        z = np.full(len(x), model["w"][0])
    else:
        z = np.hstack([np.ones((len(x), 1)), np.clip((expanded(x) - model["mean"]) / model["scale"], -8, 8)]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
