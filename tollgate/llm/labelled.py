"""Labelled rows for fitting, and the small fits shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text divisible by 5 (null ids too)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled ids that are not held out, by smallest
    hash of the id. A fit may be bounded; the ids are few enough to broadcast, no text is moved.
    Null labels, ids and texts are left out; an id labelled twice counts as the larger label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")


class Logistic:
    """Logistic regression on standardised features; the base rate where a class is missing."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean = x.mean(axis=0) if len(y) else np.zeros(x.shape[1])
        self.scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0) if len(y) else np.ones(x.shape[1])
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.weights = np.zeros(x.shape[1] + 1)
        self.weights[0] = np.log(rate / (1 - rate))
        if 0 < y.sum() < len(y):
            z = self._with_one(x)
            penalty = ridge * np.eye(z.shape[1])
            penalty[0, 0] = 1e-6

            def loss(w: np.ndarray) -> float:
                m = z @ w
                return float(np.logaddexp(0, m).sum() - y @ m + w @ penalty @ w / 2)

            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - penalty @ self.weights)
                size = 1.0
                while size > 1e-6 and loss(self.weights + size * step) > loss(self.weights):
                    size /= 2
                self.weights += size * step

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._with_one(np.asarray(x, float)) @ self.weights, -30, 30)))
