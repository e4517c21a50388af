"""A bounded sample of labelled rows for fitting, and the calibration both classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``bound`` labelled training rows, and how many training rows each class has.

    Each class gives at most ``bound / 2`` rows, those with the smallest id hash. Rows without an id or
    a label of 0 or 1 are left out; of an id that is labelled more than once the largest label counts.
    The sample is the only thing that is broadcast, so its size is bounded by the parameter.
    """
    rows = (labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).where(train)
            .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y")))
    totals = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("_id").cast("string"), F.lit("sample")), F.col("_id")]
    picked = [rows.where(F.col("_y") == y).orderBy(*order).limit(bound // 2) for y in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(few, "_id"), totals


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to chances, fitted by Newton's method."""
    if len(margin) == 0 or y.min() == y.max():
        p = float(np.clip(np.average(y, weights=weight), 0.02, 0.98)) if len(y) else 0.5
        return 0.0, float(np.log(p / (1 - p)))
    scale = float(np.std(margin)) or 1.0
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def class_weights(y: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights that give a stratified sample the class shares of all training rows."""
    have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    return np.where(y == 1, totals.get(1, 0) / have[1], totals.get(0, 0) / have[0]).astype(float)


def noisy_platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[float, float, float]:
    """Slope, offset and floor of chances where some labels of 1 are wrong: floor + (1 - floor) * logistic.

    Expectation-maximisation: each label of 1 is explained by its margin or by the floor.
    """
    slope, offset = platt(margin, y, weight)
    if slope == 0.0:
        return slope, offset, 0.0
    floor, p = 0.5 * float(np.average(y, weights=weight)), None
    p = 1 / (1 + np.exp(-np.clip(2 * slope * (margin - np.quantile(margin, 0.9)), -30, 30)))
    for _ in range(rounds):
        real = y * p / (p + (1 - p) * floor + 1e-12)
        floor = float(min(0.25, (weight * (y - real)).sum() / max(1e-9, (weight * (1 - real)).sum())))
        slope, offset = platt(margin, real, weight, 20)
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
    return (slope, offset, floor) if slope > 0 else (0.0, offset, floor)
