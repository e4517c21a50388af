"""Embedding near duplicates: int8 tile products with error bounds per vector, then full precision.

Every unit vector u is s * q + e with q in int8 and the norm of e known, so a product of two codes is off by at
most e_u + e_v + e_u * e_v. Pairs that may reach the threshold by that bound, and are not above it for
certain, are recomputed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import set_batches, stored
from synthloom.llm.components import LocalUnion, connected_components

TILE = 8192      # vectors in a block; a task multiplies two blocks
STRIP = 512      # rows of a block that are multiplied at once
EXACT_DIMS = 1024  # int8 products over so many dimensions are whole numbers that float32 holds exactly


class Block:
    """Unit vectors of one block with their int8 codes, scales and error norms."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.weight = ids, weight
        peak = np.abs(vectors).max(1, keepdims=True)
        vectors = vectors / np.where(peak > 0, peak, 1)  # so that squares neither vanish nor overflow
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.scale = np.abs(self.unit).max(1) / 127
        self.code = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        error = np.linalg.norm(self.unit - self.scale[:, None] * self.code, axis=1)
        self.error = error * (1 + 1e-9) + 1e-12


def tile_links(a: Block, b: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold, strip by strip; inside one block each pair once."""
    same = a is b
    right = b.code.astype(np.float32)
    widest = 1 + float(a.error.max())
    slack = 1e-6  # rounding of the scaled products in float32
    for at in range(0, len(a.ids), STRIP):
        rows = slice(at, at + STRIP)
        left = a.code[rows].astype(np.float32)
        near = left[:, :EXACT_DIMS] @ right[:, :EXACT_DIMS].T
        for d in range(EXACT_DIMS, left.shape[1], EXACT_DIMS):
            near += left[:, d:d + EXACT_DIMS] @ right[:, d:d + EXACT_DIMS].T
        near *= a.scale[rows, None].astype(np.float32)
        near *= b.scale.astype(np.float32)
        low = near + a.error[rows, None].astype(np.float32)
        i, j = np.nonzero(low >= (threshold - slack - widest * b.error).astype(np.float32))
        if same:
            keep = j > i + at
            i, j = i[keep], j[keep]
        bound = a.error[i + at] + b.error[j] + a.error[i + at] * b.error[j] + slack
        sure = near[i, j] - bound >= threshold
        open_ = np.flatnonzero(~sure)
        for k in range(0, len(open_), 1 << 16):
            part = open_[k:k + (1 << 16)]
            sure[part] = np.einsum("nd,nd->n", a.unit[i[part] + at], b.unit[j[part]]) >= threshold
        yield i[sure] + at, j[sure]


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                         vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one class with a weight, so copies are never paired. Classes are dealt to blocks by
    hash, every pair of blocks meets in one task, and a task returns per vector its links' weight and the
    smallest id of its links' component there - never pairs. Vectors that are null, zero or hold null or
    non-finite components, and those of another length than theirs in a pair of blocks, link with nothing.
    Rows that repeat an id count as one vector each in n_links; a null id links with nothing.
    """
    spark = vectors.sparkSession
    set_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
              & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # equal vectors are equal arrays; -0.0 and 0.0 are made one first
    plain = rows.where("ok").select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = stored(plain.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
                     .withColumn("dims", F.size("v")), "classes")
    blocks = max(1, -(-classes.count() // tile))

    own = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)),
                        lambda o: F.struct(F.least("own", o).alias("x"), F.greatest("own", o).alias("y")))
    dealt = (classes.withColumn("own", own).select("rep", "weight", "dims", "v", "own", F.explode(pairs).alias("p"))
             .groupBy("dims", "p.x", "p.y"))

    empty = pa.table({k: pa.array([], pa.int64()) for k in ("rep", "links", "root")})

    def links(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        dims, x, y = (k.as_py() for k in key)
        ids, weight = got["rep"].to_numpy(), got["weight"].to_numpy()
        flat = got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        part = got["own"].to_numpy()
        first = part == x
        a = Block(ids[first], weight[first], flat[first])
        b = a if x == y else Block(ids[~first], weight[~first], flat[~first])
        if not len(a.ids) or not len(b.ids):
            return empty
        both = np.concatenate([a.ids, b.ids]) if b is not a else a.ids
        shift = 0 if b is a else len(a.ids)
        mass = np.concatenate([a.weight, b.weight]) if b is not a else a.weight
        total, union = np.zeros(len(both), np.int64), LocalUnion(len(both))
        for i, j in tile_links(a, b, threshold):
            j = j + shift
            total += np.bincount(i, mass[j], len(both)).astype(np.int64) + np.bincount(j, mass[i], len(both)).astype(np.int64)
            union.add(i, j)
        has = np.flatnonzero(total)
        least = np.full(len(both), np.iinfo(np.int64).max)
        np.minimum.at(least, union.label, both)
        return pa.table({"rep": both[has], "links": total[has], "root": least[union.label[has]]})

    found = stored(dealt.applyInArrow(links, "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = (classes.select("v", "rep", "weight").join(counts, "rep", "left")
                .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
                .select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    linked = plain.join(by_class, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
