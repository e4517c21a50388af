"""Toxicity: a bidirectional gated recurrent network scores every overlapping window of every text.

A text's score is that of its most toxic window. Training labels are per text, so each training pass
takes the window of a toxic text that scores highest so far, and the highest and some other windows of
the rest. Labels may be wrong: a toxic text whose best window ranks below nearly all best windows of the
other class counts little in that pass.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import hashes, set_batches, split_words, text_slices
from synthloom.llm.gru import CHARS, MAX_CHARS, Adam, Network, Scorer, parameters
from synthloom.llm.sample import class_weights, labelled_sample, noisy_platt

WIDTH, STRIDE = 32, 24
STRIP = 16_384  # windows that are looked at together


def bare(words: pa.Array) -> pa.Array:
    """Words without signs at their ends; the characters are read with them."""
    return pc.ascii_trim(words, characters=string.punctuation)


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts with long words cut: (offsets, codes, words, code points, starts, lengths)."""
    offsets, codes, words = split_words(texts)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = (np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32) % CHARS).astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    long = np.flatnonzero(lengths > MAX_CHARS)
    if len(long):
        many = np.ones(len(words), np.int64)
        first = np.arange(len(words))
        many[long] = -(-lengths[long] // MAX_CHARS)
        first[long] = len(words) + np.cumsum(many[long]) - many[long]
        k = np.arange(int(many[long].sum())) - np.repeat(np.cumsum(many[long]) - many[long], many[long])
        more = np.repeat(starts[long], many[long]) + k * MAX_CHARS
        left = np.minimum(np.repeat(lengths[long], many[long]) - k * MAX_CHARS, MAX_CHARS)
        lengths[long] = 1
        starts, lengths = np.concatenate([starts, more]), np.concatenate([lengths, left])
        each = many[codes]
        at = np.concatenate([[0], np.cumsum(each)])
        codes = np.repeat(first[codes] - at[:-1], each) + np.arange(at[-1])
        offsets = at[offsets]
    return offsets, codes, words, points, starts, lengths


def window_starts(offsets: np.ndarray, width: int = WIDTH, stride: int = STRIDE):
    """(text, start, end of text) of every window; a text without words has one empty window."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-(n - width) // stride) + 1)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return text, offsets[:-1][text] + k * stride, offsets[1:][text]


@dataclass
class ToxicityModel:
    params: dict
    vocabulary: np.ndarray   # sorted 64-bit hashes of known words; row 0 of the word table is for others
    slope: float
    offset: float
    floor: float = 0.0

    def word_ids(self, words: pa.Array, total: int) -> np.ndarray:
        """Rows of the word table; pieces of long words, which follow the words, are read by characters only."""
        if len(self.vocabulary) == 0:
            return np.zeros(total, np.int64)
        h = hashes(bare(words))
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        found = np.where(self.vocabulary[at] == h, at + 1, 0)
        return np.concatenate([found, np.zeros(total - len(found), np.int64)])

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Highest window logit of every text."""
        scorer, out = Scorer(self.params), []
        for _, part in text_slices(texts, 4 << 20):
            offsets, codes, words, points, starts, lengths = pieces(part)
            f, b = scorer.words(self.word_ids(words, len(lengths)), points, starts, lengths) if len(words) else (
                np.zeros((1, scorer.p["wf.b"].shape[0]), np.float32),) * 2
            text, first, end = window_starts(offsets)
            logit = scorer.windows(f, b, codes, first, end, WIDTH)
            out.append(np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(part)))))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def score(self, texts: pa.Array) -> pa.Array:
        m = self.margins(texts).astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30)))
        return pa.array(self.floor + (1 - self.floor) * p, pa.float64())


def fit_windows(texts: list[str] | pa.Array, y: np.ndarray, totals: dict[int, int] | None = None, seed: int = 7,
                epochs: int = 4, rate: float = 0.01, batch: int = 96, steps: int = 160, word_dropout: float = 0.25) -> ToxicityModel:
    """Fit on whole texts with labels 0 and 1; a quarter of the texts is left out to fit the chances."""
    y = np.asarray(y, int)
    weight = class_weights(y, totals or {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    rng = np.random.default_rng(seed)
    fit = rng.random(len(y)) >= 0.25
    if not fit.any() or y[fit].min() == y[fit].max():
        return ToxicityModel(parameters(1, seed), np.zeros(0, np.uint64), *noisy_platt(np.zeros(len(y)), y, weight))
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    offsets, codes, words, points, starts, lengths = pieces(column)
    doc = np.repeat(np.arange(len(y)), np.diff(offsets))
    names = bare(words).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    names = np.concatenate([names, len(words) + np.arange(len(lengths) - len(words))])
    seen = np.unique(names[codes].astype(np.int64) * len(y) + doc)  # words of a text
    word, of = seen // len(y), seen % len(y)
    by = {k: np.bincount(word[fit[of] & (y[of] == k)], minlength=len(lengths))[names] for k in (0, 1)}
    known = np.flatnonzero((by[0] + by[1] >= 3)[:len(words)])
    vocabulary = np.unique(hashes(bare(words))[known])
    p = parameters(len(vocabulary) + 1, seed)
    model = ToxicityModel(p, vocabulary, 1.0, 0.0)
    ids = model.word_ids(words, len(lengths))
    prior = float(y[fit].mean())
    chance = (by[1] + 4 * prior) / (by[0] + by[1] + 4)
    odds = np.log(chance / (1 - chance)) - np.log(prior / (1 - prior))
    p["words"][ids[known], 0] += 0.3 * odds[known]

    text, first, end = window_starts(offsets)
    evidence, logit = np.zeros(len(text)), np.zeros(len(text), np.float32)
    for at in range(0, len(text) if len(codes) else 0, STRIP):
        inside = np.minimum(first[at:at + STRIP, None] + np.arange(WIDTH), len(codes) - 1)
        evidence[at:at + STRIP] = np.where(inside < end[at:at + STRIP, None], odds[codes[inside]], -9.0).max(1)
    bounds = np.searchsorted(text, np.arange(len(y) + 1))
    optimiser, net = Adam(p, rate, 1e-4), Network(p)
    t = np.arange(WIDTH)[:, None]
    batch = int(np.clip(2 * fit.sum() // 40, 16, batch))
    epochs = max(epochs, -(-steps * batch // max(1, 2 * int(fit.sum()))))  # few texts are passed over more often
    for epoch in range(epochs):
        picked = []
        if epoch < epochs / 2:
            logit = logit + evidence
        best = np.maximum.reduceat(logit, bounds[:-1])
        usual = np.quantile(best[fit & (y == 0)], 0.99) if (fit & (y == 0)).any() else -np.inf
        trust = np.where((y == 1) & (best <= usual), 0.02, 1.0)
        trust[y == 1] *= min(50.0, 2 * (fit & (y == 0)).sum() / max(1e-9, trust[fit & (y == 1)].sum()))
        for d in np.flatnonzero(fit):
            own = np.arange(bounds[d], bounds[d + 1])
            top = own[np.argmax(logit[own])]
            picked.append(top)
            if y[d] == 0:
                picked.extend(rng.choice(own, 1) if len(own) > 1 else [])
        picked = rng.permutation(np.array(picked))
        optimiser.rate = rate * (1 - epoch / (epochs + 1))
        for at in range(0, len(picked), batch):
            w = picked[at:at + batch]
            where = first[w][None] + t
            mask = where < end[w][None]
            if not mask.any():
                continue
            words_in, windows = np.unique(codes[np.where(mask, where, 0)], return_inverse=True)
            n = lengths[words_in]
            ct = np.arange(int(n.max()))[:, None]
            chars = np.where(ct < n[None], points[np.minimum(starts[words_in][None] + ct, len(points) - 1)], 0)
            own_ids = np.where(rng.random(len(words_in)) < word_dropout, 0, ids[words_in])
            z = net.forward(own_ids, chars, n, windows.reshape(mask.shape), mask)
            target = y[text[w]]
            error = (1 / (1 + np.exp(-z)) - target) * trust[text[w]] / len(w)
            optimiser.step(net.backward(error.astype(np.float32)))
        scorer = Scorer(p)
        f, b = scorer.words(ids, points, starts, lengths)
        logit = scorer.windows(f, b, codes, first, end, WIDTH)
    margin = np.maximum.reduceat(logit, bounds[:-1]).astype(np.float64)
    left = ~fit if y[~fit].sum() >= 30 else np.ones(len(y), bool)  # few toxic texts: all of them count
    model.slope, model.offset, model.floor = noisy_platt(margin[left], y[left], weight[left])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", bound: int = 3000,
                 id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most ``bound`` labelled rows (half per class) for which ``train`` holds.

    The sample goes to one task, which its bound allows; the driver only gets the model.
    """
    set_batches(docs.sparkSession)
    sample, totals = labelled_sample(docs, labels, label, train, bound, id_col, text_col)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        got = pa.Table.from_batches(held).sort_by("_key")
        model = fit_windows(got["_text"].combine_chunks(), got["_y"].to_numpy(), totals)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = sample.select("_y", "_text", F.col("_id").cast("string").alias("_key")).repartition(1)
    made = rows.mapInArrow(fit, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit_windows(pa.array([], pa.string()), np.zeros(0, int), totals)


def toxicity_score(model: ToxicityModel, text: Column | str) -> Column:
    """Chance of label 1 for each text; null and empty texts score as one empty window."""
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield model.score(t)
    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, held_out: Column, threshold: float = 0.3,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score and predicted (score >= threshold).

    Null ids are kept and scored, repeated rows give repeated results, other columns are not looked at.
    """
    model = fit_toxicity(docs, labels, train, id_col=id_col, text_col=text_col)
    return docs.select(F.col(id_col), held_out.alias("held_out"),
                       toxicity_score(model, F.col(text_col)).alias("score")
                       ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
