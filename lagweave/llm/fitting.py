"""Bounded labelled samples for the models that are fitted on the driver, and the fit they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo `folds`, is `fold`. Null ids are in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label of at most `per_class` rows of each class outside the held-out fold, and the classes' true counts.

    The rows are those whose ids hash lowest. Null ids and labels are left out; of contradicting labels the smaller counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), folds, fold))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    # Each class keeps its lowest hashes: a threshold near the wanted share leaves few rows for the window to rank.
    share = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(min(1.0, 2.0 * per_class / max(1, counts.get(k, 0)) + 0.01)))])
    near = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < share[F.col("label")] * 1_000_000)
    return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_class).drop("_k"), counts


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, label of the sampled ids; the sample is bounded, so it is broadcast."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(sample), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights (the last one for the constant) by Newton steps; a ridge draws them to `prior`, the constant freely."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = prior.astype(float).copy(), np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - pull * (w - prior)
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    return w
