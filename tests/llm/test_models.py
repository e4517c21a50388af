"""Classifiers and the language model: held-out accuracy, gradients, proper distributions, odd rows."""

from __future__ import annotations

import math
import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synthloom.llm.common import discard, held, stored
from synthloom.llm.gru import Network, Scorer, parameters
from synthloom.llm.quality import fit_nbsvm, score_quality
from synthloom.llm.suffixtree import LEVEL, Index, Sizes, _deal, _grown, _met, longer, suffix_tree_scores
from synthloom.llm.toxicity import fit_windows, pieces, score_toxicity, window_starts
from synthloom.session import work_dir
from tests.llm.cases import documents, empty, prose, rows, words


def labelled(spark, mark: str, n: int = 240):
    """Documents of which a third holds a marked word, once, at any place; labels for most."""
    import random
    rng = random.Random(5)
    data, labels = [], []
    for i in range(n):
        own = prose(rng, rng.randrange(20, 150)).split(" ")
        bad = i % 3 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice([mark, mark + "s", mark.upper() + "!"])
        data.append((i, " ".join(own), "x"))
        if i % 7:
            labels.append((i, int(bad), int(not bad)))
    labels += [(0, None, None), (None, 1, 1), (10**9, 1, 0), (1, 0, 1)]
    return (spark.createDataFrame(data, "doc_id long, text string, toxic string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


@pytest.mark.parametrize("score,wrong", [(score_toxicity, 0.1), (score_quality, 0.2)])
def test_classifiers(spark, score, wrong):
    docs, labels = labelled(spark, "grobian")
    rest = held("doc_id", 4)
    docs = docs.unionByName(documents(spark).withColumn("doc_id", F.col("doc_id") + 10**6).select("doc_id", "text", F.col("lang").alias("toxic")))
    got = score(docs, labels, rest != 2, rest == 2).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    mine = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    want = (lambda i: i % 3 == 0) if score is score_toxicity else (lambda i: i % 3 != 0)
    assert np.mean([r["predicted"] != int(want(r["doc_id"])) for r in mine]) <= wrong
    again = {r["doc_id"]: r["score"] for r in score(docs, labels, rest != 2, rest == 2).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in mine)
    assert score(empty(spark), labels, rest != 2, rest == 2).count() == 0
    none = score(documents(spark), labels.limit(0), rest != 2, rest == 2).collect()
    assert len({r["score"] for r in none}) == 1


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in parameters(5, 1).items()}
    chars, lengths = rng.integers(0, 512, (4, 6)), np.array([4, 2, 1, 3, 4, 2])
    windows = rng.integers(0, 6, (5, 3))
    mask = np.arange(5)[:, None] < np.array([5, 3, 1])
    y = np.array([1.0, 0, 1])
    args = (np.array([0, 1, 2, 3, 4, 1]), chars, lengths, windows, mask)

    def loss():
        z = Network(p).forward(*args)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    net = Network(p)
    g = net.backward(1 / (1 + np.exp(-net.forward(*args))) - y)
    for k, v in p.items():
        where = [np.unravel_index(i, v.shape) for i in rng.choice(v.size, min(4, v.size), replace=False)]
        if k == "chars":
            where = [(chars[0, 0], 1), (chars[1, 3], 2)]
        for at in where:
            old = v[at]
            v[at] = old + 1e-3
            up = loss()
            v[at] = old - 1e-3
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 1e-2 * max(1, abs(g[k][at])), k


def test_fast_scores_equal_the_training_pass():
    texts = [r[1] or "" for r in rows()][:40] + ["y" * 100 + " end", ""]
    offsets, codes, found, points, starts, lengths = pieces(pa.array(texts))
    assert int(lengths.max()) <= 32 and sum(np.diff(offsets)) == len(codes)
    p = parameters(7, 3)
    ids = np.arange(len(lengths)) % 7
    text, first, end = window_starts(offsets)
    assert set(text.tolist()) == set(range(len(texts)))
    scorer = Scorer(p)
    fast = scorer.windows(*scorer.words(ids, points, starts, lengths), codes, first, end, 32)
    t = np.arange(32)[:, None]
    for w in range(0, len(text), 7):
        where = first[w] + t
        mask = where < end[w]
        if mask.any():
            own, at = np.unique(codes[np.where(mask, where, first[w])], return_inverse=True)
            ct = np.arange(int(lengths[own].max()))[:, None]
            chars = np.where(ct < lengths[own], points[np.minimum(starts[own] + ct, len(points) - 1)], 0)
            assert abs(Network(p).forward(ids[own], chars, lengths[own], at.reshape(mask.shape), mask)[0] - fast[w]) < 1e-3
    # every word lies in a window
    cover = np.zeros(len(codes), bool)
    for f, e in zip(first, end):
        cover[f:min(e, f + 32)] = True
    assert cover.all()


def test_fits_without_rows_or_with_one_class():
    assert fit_nbsvm([], np.zeros(0)).score(pa.array(["a"])).to_pylist() == [0.5]
    assert fit_nbsvm([np.array([1], np.int32)] * 3, np.ones(3)).score(pa.array(["a"])).to_pylist()[0] > 0.9
    assert fit_windows([], np.zeros(0)).score(pa.array(["a", None, ""])).to_pylist() == [0.5] * 3


def test_suffix_tree_scores(spark):
    docs, rest = documents(spark), held("doc_id", 10)
    got = suffix_tree_scores(docs, rest != 0, rest == 0).collect()
    plain = docs.withColumn("h", rest).collect()
    counts = Counter(w for r in plain if r["h"] for w in [*words(r["text"]), "\n"])
    total, bottom = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = Counter()
    for r in plain:
        own = [*words(r["text"]), "\n"]
        base = sum(math.log10((counts[w] + 0.1) / bottom) for w in own)
        want[(r["doc_id"], r["h"] == 0, len(own), sum(counts[w] > 0 for w in own), total, round(base, 5))] += 1
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))
                           for r in got)
    assert suffix_tree_scores(empty(spark), rest != 0, rest == 0).count() == 0


class PlainTree:
    """The tree by its definition, over dicts of tuples of words."""

    def __init__(self, texts: list[str | None], sizes: Sizes = Sizes()) -> None:
        self.sizes, self.own = sizes, [[*words(t), "\n"] for t in texts]
        self.words = Counter(w for t in self.own for w in t)
        self.total = sum(self.words.values())
        self.bottom = self.total + 0.1 * (len(self.words) + 1)
        self.lengths, k = [0], 1
        self.next: dict[tuple, Counter] = {}
        while True:
            found: dict[tuple, Counter] = {}
            for t in self.own:
                for i in range(k, len(t)):
                    found.setdefault(tuple(t[i - k:i]), Counter())[t[i]] += 1
            found = {c: n for c, n in found.items() if sum(n.values()) >= sizes.state}
            if not found:
                break
            self.next |= found
            self.lengths.append(k)
            k = longer(k)
        self.seen: dict[tuple, dict | None] = {}

    def state(self, context: tuple) -> tuple[dict, float] | None:
        """(chances of listed words, back-off factor) of a kept context, else nothing."""
        if context not in self.seen:
            self.seen[context] = None
            n = self.next.get(context)
            if n:
                suffix = context[len(context) - self.lengths[self.lengths.index(len(context)) - 1]:]
                listed = {w: c for w, c in n.items() if c >= self.sizes.pair}
                count, low = sum(n.values()), {w: self.chance(suffix, w) for w in listed}
                rest, rest_low = count - sum(listed.values()), max(1 - sum(low.values()), 1e-9)
                gain = sum(c / count * math.log(c / count / low[w]) for w, c in listed.items())
                gain += rest / count * math.log(rest / count / rest_low) if rest else 0
                if listed and count * gain > 0.5 * (len(listed) + 1) * math.log(count):
                    weight = self.sizes.weight
                    self.seen[context] = ({w: (c + weight * low[w]) / (count + weight) for w, c in listed.items()},
                                          (rest / rest_low + weight) / (count + weight))
        return self.seen[context]

    def chance(self, context: tuple, word: str) -> float:
        """Of a word after a context of one of the lengths, by its longest kept suffix."""
        if not context:
            return (self.words[word] + 0.1) / self.bottom
        shorter = context[len(context) - self.lengths[self.lengths.index(len(context)) - 1]:]
        state = self.state(context)
        if state is None:
            return self.chance(shorter, word)
        return state[0][word] if word in state[0] else state[1] * self.chance(shorter, word)

    def score(self, text: str | None) -> float:
        own = [*words(text), "\n"]
        return sum(math.log10(self.chance(tuple(own[i - max(k for k in self.lengths if k <= i):i]), w)) for i, w in enumerate(own))


def test_suffix_tree_equals_its_definition(spark):
    """Scores, at any share of strings that travel, and chances after every context that sum to one."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(rng.choice(["a b c", "x b d", "b", "e f g h i j", "k"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    texts += [f"start{i % 3} {passage} {'yes' if i % 3 else 'no'} {rng.choice('abc')}" for i in range(120)] + [passage] * 40 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tree = PlainTree([t for i, t in enumerate(texts) if i % 10])
    assert max(tree.lengths) >= 24 and sum(tree.state(c) is not None for c in list(tree.next)) > 20
    for context in [(), ("b",), ("a", "b"), ("x", "b"), ("e", "f", "g"), *[c for c in tree.next if len(c) == 24][:2]]:
        known = sum(tree.chance(context, w) for w in tree.words)
        assert abs(known - 1) < 0.02, context
    for share in (1e-9, 1e-2, 2.0):  # all short strings, some and none travel with the task
        got = suffix_tree_scores(docs, F.col("doc_id") % 10 != 0, F.col("doc_id") % 10 == 0, Sizes(frequent=share)).collect()
        assert len(got) == len(texts)
        for r in got:
            assert abs(r["score"] - tree.score(texts[r["doc_id"]])) < 1e-8, r


def test_suffix_tree_keeps_rare_long_contexts_of_a_large_corpus(spark):
    """Forty occurrences of a passage that three words of context decide, in 200,000 other tokens."""
    import random
    rng = random.Random(9)
    other = [" ".join(f"w{rng.randrange(20)}" for _ in range(2000)) for _ in range(100)]
    passage = ["left m n o yes", "right m n o no"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(other + passage * 40)] + [(-1, passage[0]), (-2, passage[0].replace("yes", "no"))],
                                 "doc_id long, text string")
    runs = []
    for share in (1e-9, 1e-3, 2.0):  # all strings, some and none travel with the task
        got = {r["doc_id"]: r for r in suffix_tree_scores(docs, F.col("doc_id") >= 0, F.col("doc_id") < 0, Sizes(frequent=share)).collect()}
        runs.append({k: round(r["score"], 6) for k, r in got.items()})
    assert runs[0] == runs[1] == runs[2]
    assert runs[0][-1] > runs[0][-2] + 0.3
    assert runs[0][-1] > got[-1]["base_score"] + 5


def test_suffix_tree_in_small_parts(spark):
    """Buckets of a few rows, joined and answered a few at a time, with rows that wait in files, give the same scores."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a b c", "x b d", "b", "e f g h i j", "k", f"r{rng.randrange(300)}"]) for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += [f"start{i % 3} a b e f {'yes' if i % 3 else 'no'}" for i in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tree = PlainTree([t for i, t in enumerate(texts) if i % 10])
    small = Sizes(frequent=2.0, bucket=64, rows=4, waiting=100, sums=9)
    got = suffix_tree_scores(docs, F.col("doc_id") % 10 != 0, F.col("doc_id") % 10 == 0, small).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        assert abs(r["score"] - tree.score(texts[r["doc_id"]])) < 1e-8, r


def test_suffix_tree_holds_a_part_of_a_frequent_words_rows():
    """A bucket in which one context has 400,000 listed next words: memory does not follow their number."""
    n, own = 400_000, np.array([5], np.uint64)
    peaks = []
    for rows in (n // 8, n):
        word = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ctx, zero, two, low = np.full(rows, 5, np.uint64), np.zeros(rows, np.uint64), np.full(rows, 2), np.full(rows, 0.5 / n)
        sent = [*_deal(0, 1, own, own, np.array([2 * n]))]
        for at in range(0, rows, 1 << 14):
            sent += _deal(1, 1, *(x[at:at + (1 << 14)] for x in (ctx, ctx, zero, word, two, low)))
        tracemalloc.start()
        made = kept = 0
        for b in _grown(_met(iter(sent), 2, 5, 1 << 14), 1, Sizes(waiting=1 << 20)):
            assert b.schema.names == [x.split()[0] for x in LEVEL.split(", ")]
            made += len(b)
            kept += sum(m == 1 for m in b.column("m").to_pylist()[:1])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert made == rows + kept
    assert peaks[1] < 1.5 * peaks[0], peaks


def test_index_of_one_bucket_has_short_ranges():
    """Hashes that share their leading bits are found, and no range holds more than a few."""
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 50, 20_000).astype(np.uint64) + (np.uint64(77) << np.uint64(50)))
    index = Index(keys)
    assert np.diff(index.first).max() < 16
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(np.array([0, int(keys[0]) - 1, int(keys[-1]) + 1, (1 << 64) - 1], np.uint64)) == -1).all()
    assert index.find(keys + np.uint64(1)).max() < len(keys) and Index(keys[:0]).find(keys).max() == -1
    assert Index(keys[:1]).find(keys[:2]).tolist() == [0, -1]


def test_suffix_tree_leaves_its_values_only(spark):
    """Of the tables written on the way one remains: the strings that the returned rows look up."""
    folder = work_dir(spark, "none").rpartition("/")[0].removeprefix("file:")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(i, "a b c d e f " * 30) for i in range(40)], "doc_id long, text string")
    got = suffix_tree_scores(docs, F.col("doc_id") >= 0, F.col("doc_id") < 0)
    assert [x.rpartition("-")[0] for x in set(os.listdir(folder)) - before] == ["values"]
    assert got.count() == 40


def test_discard_leaves_other_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "given"))
    given, own = spark.read.parquet(str(tmp_path / "given")), stored(spark.range(4), "own")
    folder = own.stored_at.removeprefix("file:")
    discard(given)
    assert given.count() == 3 and os.path.exists(folder)
    discard(own)
    assert not os.path.exists(folder)
