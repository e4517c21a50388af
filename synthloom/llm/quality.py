"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators of word and word-shape uni- and bigrams are scaled by the log-count ratio of the two classes;
a linear hinge-loss model on the scaled indicators is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import binary_list, hashes, mix, set_batches, split_words, text_slices
from synthloom.llm.sample import class_weights, labelled_sample, platt

BITS = 18
SLICE = 2 << 20  # bytes of texts whose features are found together


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct feature numbers of every text: per slice (offsets, features)."""
    size = np.uint64(1 << bits)
    two, shape_salt = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
    for _, part in text_slices(texts, SLICE):
        offsets, codes, words = split_words(part)
        shapes = pc.replace_substring_regex(
            pc.replace_substring_regex(words, r"\pL+", "a"), r"[0-9]+", "0")
        by_word = hashes(words)
        by_shape = hashes(shapes) ^ shape_salt
        count = len(offsets) - 1
        doc = np.repeat(np.arange(count, dtype=np.int64), np.diff(offsets))
        follows = np.ones(len(codes), bool)
        first = offsets[:-1][np.diff(offsets) > 0]
        follows[first] = False
        keys = []
        for table in (by_word, by_shape):
            seq = table[codes]
            pair = mix(seq[:-1] * two + seq[1:]) if len(seq) else seq
            keys.append((doc << bits) + (mix(table) % size).astype(np.int64)[codes])
            keys.append(((doc[1:] << bits) + (pair % size).astype(np.int64))[follows[1:]])
        again = follows[1:] & (codes[1:] == codes[:-1])  # the n-grams "x x" and "x x x" of any word x
        keys.append((doc[1:][again] << bits) + (1 << bits) - 2)
        thrice = again[1:] & again[:-1]
        keys.append((doc[2:][thrice] << bits) + (1 << bits) - 3)
        keys.append((np.arange(count, dtype=np.int64) << bits) + (1 << bits) - 1)  # every text has this one
        flat = np.concatenate(keys)
        flat.sort()
        flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])] if len(flat) else flat
        bounds = np.searchsorted(flat, np.arange(count + 1, dtype=np.int64) << bits)
        yield bounds, (flat & ((1 << bits) - 1)).astype(np.int32)


@dataclass
class NBSVM:
    """Fitted model; ``weights`` already hold the log-count ratios."""

    weights: np.ndarray
    slope: float
    offset: float
    bits: int = BITS

    def score(self, texts: pa.Array) -> pa.Array:
        out = []
        for bounds, feats in features(texts, self.bits):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[feats], dtype=np.float64)])
            margin = sums[bounds[1:]] - sums[bounds[:-1]]
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())


def _dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray,
                  epochs: int, seed: int) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model; each step solves one dual variable exactly."""
    w = np.zeros(len(values))
    alpha = np.zeros(len(rows))
    norm = np.array([float((values[r] ** 2).sum()) for r in rows])
    rng = np.random.default_rng(seed)
    active = np.flatnonzero(norm > 0)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(active):
            r = rows[i]
            x = values[r]
            slack = y[i] * float(w[r] @ x) - 1.0
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * x
                worst = max(worst, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def fit_nbsvm(rows: list[np.ndarray], y: np.ndarray, totals: dict[int, int] | None = None, bits: int = BITS,
              smooth: float = 1.0, cost: float = 0.05, epochs: int = 20, folds: int = 3, seed: int = 7) -> NBSVM:
    """Fit on indicator rows (arrays of distinct feature numbers) with labels 0 and 1.

    Margins of rows left out (``folds``) fit the curve to chances. With one class only, every score is
    that class's share; without rows it is one half.
    """
    y = np.asarray(y, int)
    size = 1 << bits
    weight = class_weights(y, totals or {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    if len(rows) == 0 or y.min() == y.max():
        return NBSVM(np.zeros(size, np.float32), *platt(np.zeros(len(rows)), y, weight), bits)

    def one(pick: np.ndarray) -> np.ndarray:
        counts = np.full((2, size), smooth)
        for k in (0, 1):
            own = [rows[i] for i in pick if y[i] == k]
            if own:
                counts[k] += np.bincount(np.concatenate(own), minlength=size)
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        share = np.array([(y[pick] == k).mean() for k in (0, 1)])
        c = cost * 0.5 / np.maximum(share, 1e-3)
        return ratio * _dual_descent([rows[i] for i in pick], ratio, np.where(y[pick] == 1, 1.0, -1.0),
                                     c[y[pick]], epochs, seed)

    everyone = np.arange(len(rows))
    fold = np.random.default_rng(seed).permutation(len(rows)) % folds
    margin = np.zeros(len(rows))
    for k in range(folds):
        pick = everyone[fold != k]
        if len(pick) == 0 or y[pick].min() == y[pick].max():
            continue
        w = one(pick)
        for i in everyone[fold == k]:
            margin[i] = w[rows[i]].sum()
    return NBSVM(one(everyone).astype(np.float32), *platt(margin, y, weight), bits)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", bound: int = 12_000,
                id_col: str = "doc_id", text_col: str = "text") -> NBSVM:
    """Fit on at most ``bound`` labelled rows for which ``train`` holds; texts are turned to features on executors."""
    set_batches(docs.sparkSession)
    sample, totals = labelled_sample(docs, labels, label, train, bound, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f[s:e] for bounds, f in features(b.column("_text")) for s, e in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column("_y"), binary_list(rows), b.column("_id").cast("string")],
                                             ["y", "f", "id"])

    got = sample.mapInArrow(encode, "y int, f binary, id string").toArrow().sort_by("id")
    rows = [np.frombuffer(x, np.int32) for x in got["f"].to_pylist()]
    return fit_nbsvm(rows, got["y"].to_numpy().astype(int), totals)


def quality_score(model: NBSVM, text: Column | str) -> Column:
    """Chance of label 1 for each text; null and empty texts get the score of a text without words."""
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield model.score(t)
    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, held_out: Column, threshold: float = 0.3,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score and predicted (score >= threshold).

    Null ids are kept and scored, repeated rows give repeated results, other columns are not looked at.
    """
    model = fit_quality(docs, labels, train, id_col=id_col, text_col=text_col)
    return docs.select(F.col(id_col), held_out.alias("held_out"), quality_score(model, F.col(text_col)).alias("score")
                       ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
