"""Bounded samples of labelled documents, and calibration of margins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most ``per_class`` texts of each class of a 0/1 label, not held out, chosen by the hash of the id.

    Ids are chosen from the narrow label table first (two top-n queries); only the texts of the chosen ones travel. Of
    conflicting labels of one id the highest counts. Also gives each text the weight that restores the rate of its class.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    present = docs.select(F.col(f"`{id_col}`").alias("id")).where(F.col("id").isNotNull()).distinct()
    known = known.groupBy("id").agg(F.max("y").alias("y")).join(present, "id", "left_semi").withColumn("order", F.xxhash64(F.col("id").cast("string"), F.lit(label)))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("order", "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # The chosen ids are at most 2 * per_class narrow rows, so they may be broadcast.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.max("y").alias("y"), F.max("text").alias("text"), F.max("order").alias("order")).orderBy("order", "id").collect()
    y = np.array([r.y for r in rows], np.int64)
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    weights = np.array([totals[r.y] for r in rows], np.float64) / np.maximum(np.bincount(y, minlength=2)[y], 1)
    return [r.text or "" for r in rows], y, weights


def logistic(margin: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit, with the smoothed targets that keep a separable fit finite."""
    weights = np.ones(len(margin)) if weights is None else weights / weights.mean()
    positive, negative = int((labels == 1).sum()), int((labels == 0).sum())
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    centre, spread = float(margin.mean()), float(margin.std()) or 1.0
    x = np.stack([(margin - centre) / spread, np.ones(len(margin))], axis=1)
    w = np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weights @ (np.logaddexp(0, z) - target * z) + 1e-3 * w @ w)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weights * (p - target)) + 2e-3 * w
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def calibrated(margin: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] * margin + scale[1], -500, 500)))
