"""Connected components: inside a task by union of labels, across tasks by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthloom.session import persist_reliably


TASK_LINKS = 500_000  # links that a task of a round handles


class LocalUnion:
    """Components of a bounded set of nodes 0..n-1, fed with arrays of links."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        new = x != y
        if not new.any():
            return
        n = len(self.label)
        keys = np.unique(np.minimum(x[new], y[new]) * n + np.maximum(x[new], y[new]))
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            path = []
            while (up := parent.get(v, v)) != v:
                path.append(v)
                v = up
            for p in path:
                parent[p] = v
            return v

        for p, q in zip((keys // n).tolist(), (keys % n).tolist()):
            p, q = root(p), root(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
        if parent:
            move = np.arange(n)
            keys = np.fromiter(parent, np.int64, len(parent))
            move[keys] = [root(int(k)) for k in keys]
            self.label = move[self.label]


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each node of ``edges`` (columns a, b) can reach.

    Alternating large and small stars: every round hooks each node's larger neighbours to the smallest node
    near it. Minima are taken by partial aggregation and joined back, so a node with very many links is
    spread by the join's skew handling. Rounds are cut by reliable checkpoints; self links give single nodes.
    """
    everything = persist_reliably(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = everything.where("a = b").select(F.col("a").alias("id"))
    pairs = everything.where("a <> b")
    tasks = max(1, -(-pairs.count() // TASK_LINKS))  # rounds only ever shrink what the first one reads
    seen = None
    for _ in range(max_rounds):
        pairs = pairs.coalesce(tasks)
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m")).coalesce(tasks)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(
            "a <> b").distinct().coalesce(tasks)
        low = _least(large)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = persist_reliably(small.union(low.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks))
        state = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    found = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("id")).union(loops).distinct().join(found, "id", "left_anti")
    return found.union(roots.select("id", F.col("id").alias("component")))
