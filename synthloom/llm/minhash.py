"""MinHash near duplicates with tensored banding.

Two small collections of minhash tuples are kept per text; every pair of one tuple of each gives a table key, so
``tables ** 2`` tables come from ``2 * tables * width`` minhashes. Texts that share a key are candidates; links
are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import binary_list, hashes, mix, set_batches, split_words, stored, text_slices
from synthloom.llm.components import LocalUnion, connected_components

WORDS = 5
SLICE = 2 << 20               # bytes of texts whose shingles are found together
TABLES, WIDTH = 7, 2          # at similarity 0.85 a linked pair shares no key with a chance of 0.00025
BLOCK = 256                   # sets of a block whose products are taken at once
SKETCH_BITS = 4               # bits of each minhash that candidates are compared by


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[list[np.ndarray]]:
    """Per slice, the sorted distinct shingle hashes of every text; none for a text without words."""
    step = np.uint64(0x9E3779B97F4A7C15)
    for _, part in text_slices(texts, SLICE):
        offsets, codes, distinct = split_words(part)
        h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        n = max(0, len(h) - words + 1)
        roll = h[:n].copy()
        for k in range(1, words):
            roll = mix(roll * step + h[k:k + n])
        out = []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if e - s >= words:
                own = np.sort(roll[s:e - words + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif e > s:  # fewer words than a shingle has: the whole sequence is one
                value = np.full(1, e - s, np.uint64)
                for k in range(s, e):
                    value = mix(value * step + h[k:k + 1])
                out.append(value)
            else:
                out.append(np.zeros(0, np.uint64))
        yield out


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(texts, count) minhashes; every set must have members."""
    rng = np.random.default_rng(20240607)
    factors = rng.integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), count), np.uint64)
    for i, f in enumerate(factors):
        out[:, i] = np.minimum.reduceat(flat * f, starts)
    return mix(out)


def table_keys(signature: np.ndarray, tables: int, width: int) -> np.ndarray:
    """(texts, tables ** 2) keys: each tuple of the first collection with each of the second."""
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    tuples = signature.reshape(len(signature), 2, tables, width)
    folded = np.zeros(tuples.shape[:3], np.uint64) + np.arange(tables, dtype=np.uint64) + np.uint64(1)
    for k in range(width):
        folded = mix(folded * step + tuples[..., k])
    both = mix(folded[:, 0, :, None] * step + folded[:, 1, None, :])
    return both.reshape(len(signature), tables * tables)


def sketches(signature: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(texts, bits) longs: bit i of the b-th tells bit b of minhash i."""
    count = signature.shape[1]
    place = np.uint64(1) << np.arange(count, dtype=np.uint64)
    return np.stack([((signature >> np.uint64(b) & np.uint64(1)) * place).sum(1, dtype=np.uint64)
                     for b in range(bits)], 1).view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, tables: int, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, sketch longs and table keys of every text."""
    count = 2 * tables * width
    if count > 63:
        raise ValueError("at most 63 minhashes fit the sketches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in shingle_sets(b.column("text"), words):
                n = len(sets)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                name, sk = np.zeros((n, 2), np.int64), np.zeros((n, SKETCH_BITS), np.int64)
                keys: list = [None] * n
                if len(full):
                    own = [sets[i] for i in full]
                    flat, starts = np.concatenate(own), np.cumsum([0] + [len(s) for s in own[:-1]])
                    name[full, 0] = np.add.reduceat(mix(flat), starts).view(np.int64)
                    name[full, 1] = np.bitwise_xor.reduceat(mix(flat * np.uint64(3)), starts).view(np.int64)
                    signature = minhashes(own, count)
                    sk[full] = sketches(signature)
                    for i, row in zip(full.tolist(), table_keys(signature, tables, width).view(np.int64)):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, n), pa.array(size), pa.array(name[:, 0]), pa.array(name[:, 1]),
                     *[pa.array(sk[:, k].copy()) for k in range(SKETCH_BITS)], pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "name1", "name2", *[f"s{k}" for k in range(SKETCH_BITS)], "keys"])
                at += n

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = ", ".join(f"s{k} long" for k in range(SKETCH_BITS))
    return rows.mapInArrow(run, f"doc_id long, n_shingles long, name1 long, name2 long, {sk}, keys array<long>")


def least_equal(percent: int, count: int) -> int:
    """Equal sketch parts that a linked pair has but for a chance of about one in a million (five deviations)."""
    same = percent / 100 + (1 - percent / 100) / (1 << SKETCH_BITS)
    return max(0, int(count * same - 5 * (count * same * (1 - same)) ** 0.5))


def _alike(a: str, b: str, percent: int, count: int):
    """Sizes and sketches that a linked pair has."""
    differ = F.lit(0).cast("long")
    for k in range(SKETCH_BITS):
        differ = differ.bitwiseOR(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}")))
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.bit_count(differ) <= count - least_equal(percent, count)) & (F.least(x, y) * 100 >= F.greatest(x, y) * percent)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity."""
    both = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column("x"), t.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def set_links(left: list[np.ndarray], right: list[np.ndarray], percent: int,
              columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets that reach the similarity, by products of incidence matrices."""
    flat = np.concatenate([*left, *right])
    size = np.array([len(s) for s in [*left, *right]])
    row = np.repeat(np.arange(len(size)), size)
    _, column = np.unique(flat, return_inverse=True)
    n = len(left)
    first = row < n
    both = np.zeros((column.max() + 1, 2), bool)
    both[column[first], 0] = True
    both[column[~first], 1] = True
    number = np.cumsum(both.all(1)) - 1
    use = both.all(1)[column]
    row, column = row[use], number[column[use]]
    common = np.zeros((n, len(size) - n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        s, e = np.searchsorted(column, [at, at + columns])
        grid = np.zeros((len(size), columns), np.float32)
        grid[row[s:e], column[s:e] - at] = 1
        common += grid[:n] @ grid[n:].T
    common = common.astype(np.int64)
    union = size[:n, None] + size[None, n:] - common
    return np.nonzero(100 * common >= percent * union)


def cluster_links(parts: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join parts of a cluster: each set outside the largest part against all sets.

    Sets are dealt to blocks by hash; a task multiplies two blocks and returns each set's link to the
    smallest one of its component there.
    """
    per = parts.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    mixed = per.groupBy("cluster").agg(F.max_by("part", "n").alias("main"), F.sum("n").alias("m"), F.count("*").alias("k")
                                       ).where("k > 1").drop("k")
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = parts.join(mixed, "cluster").withColumn("minor", F.col("part") != F.col("main")).withColumn("own", own).withColumn(
        "last", blocks - 1)
    begin = F.when(F.col("minor"), F.col("own")).otherwise(0)  # two minor sets meet once
    left = rows.select("rep", "cluster", F.lit(0).alias("side"), F.col("own").alias("x"), F.explode(F.sequence(begin, "last")).alias("y"))
    right = rows.where("minor").select("rep", "cluster", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), "last")).alias("x"),
                                       F.col("own").alias("y"))

    def links(got: pa.Table) -> pa.Table:
        side, rep = got["side"].to_numpy(), got["rep"].to_numpy()
        own = [np.frombuffer(s, np.uint64) for s in got["shingles"].to_pylist()]
        sides = [np.flatnonzero(side == k) for k in (0, 1)]
        union = LocalUnion(len(rep))
        linked = np.zeros(len(rep), bool)
        if len(sides[0]) and len(sides[1]):
            i, j = set_links([own[k] for k in sides[0]], [own[k] for k in sides[1]], percent)
            i, j = sides[0][i], sides[1][j]
            apart = rep[i] != rep[j]
            union.add(i[apart], j[apart])
            linked[i[apart]] = linked[j[apart]] = True
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, union.label, rep)
        root = least[union.label]
        use = linked & (root != rep)
        return pa.table({"a": root[use], "b": rep[use]})

    return left.union(right).join(sets, "rep").groupBy("cluster", "x", "y").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, tables: int = TABLES, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts link where 100 * intersection >= percent * union of their shingle sets. Equal sets are one class, whose
    smallest id stands for it. In each bucket of a table all classes are first held against its smallest and
    largest id. Classes that sketches find alike to such a hub form clusters; where confirmed links leave a
    cluster in several parts, its sets are multiplied block by block, and only a spanning set of links comes
    out. What shares a bucket but no cluster is paired by sketches. So no candidate link is lost, and a
    group of alike texts is never expanded into rows of pairs. Texts without words link with nothing; so do
    rows without an id, which are kept and have no component.
    """
    set_batches(docs.sparkSession)
    count = 2 * tables * width
    marked = stored(signed(docs, id_col, text_col, words, tables, width), "minhashes")
    linkable = marked.where("n_shingles > 0 AND doc_id IS NOT NULL")
    own = ["n_shingles", *[f"s{k}" for k in range(SKETCH_BITS)]]
    classes = stored(linkable.groupBy("name1", "name2", *own).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")),
                     "classes")  # equal sets have equal keys
    keys = classes.select(F.explode("keys").alias("key"), "rep")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")
                                     ).where("n > 1").drop("n")
    buckets = stored(keys.join(shared, "key"), "buckets")

    about = classes.select("rep", *own)
    near = (buckets.select("rep", F.explode(F.array("low", "high")).alias("hub")).where("rep <> hub")
            .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    loose = stored(near.join(about.alias("x"), F.col("a") == F.col("x.rep")).join(
        about.alias("y"), (F.col("b") == F.col("y.rep")) & _alike("x", "y", percent, count)).select("a", "b"), "loose")

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    needed = buckets.select("rep").distinct()

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for part in shingle_sets(b.column("text"), words) for s in part]
            yield pa.RecordBatch.from_arrays([b.column("rep"), binary_list(sets)], ["rep", "shingles"])

    # an id that is repeated with other texts stands for its class only where the set has the class's size
    sets = texts.join(needed, "rep", "left_semi").mapInArrow(to_sets, "rep long, shingles binary")
    sets = stored(sets.join(about.select("rep", "n_shingles"), "rep").where(F.length("shingles") == F.col("n_shingles") * 8)
                  .select("rep", "shingles").dropDuplicates(["rep"]), "sets")

    links = stored(confirm(loose, sets, percent), "links")
    parts = stored(connected_components(loose).join(
        connected_components(links).select("id", F.col("component").alias("part")), "id", "left").select(
        F.col("id").alias("rep"), F.col("component").alias("cluster"), F.coalesce("part", "id").alias("part")), "parts")
    inner = stored(cluster_links(parts, sets, percent), "links")

    # pairs of a bucket that no chain of alike hubs joins
    placed = buckets.select("key", "rep").join(parts.select("rep", "cluster"), "rep", "left").withColumn(
        "cluster", F.coalesce("cluster", "rep"))
    per = placed.groupBy("key", "cluster").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.max_by("cluster", "n").alias("main"), F.count("*").alias("n")).where("n > 1").drop("n")
    open_ = placed.join(mixed, "key").join(about, "rep")
    x, y = open_.alias("x"), open_.where("cluster <> main").alias("y")
    second = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cluster") != F.col("y.cluster"))
                     & _alike("x", "y", percent, count))
              .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())
    more = stored(confirm(second, sets, percent), "links")
    groups = connected_components(links.union(inner).union(more))
    named = classes.select("name1", "name2", "n_shingles", "rep").join(
        groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        "name1", "name2", "n_shingles", F.coalesce("component", "rep").alias("_root"))
    linked = linkable.select("doc_id", "n_shingles", "name1", "name2").join(named, ["name1", "name2", "n_shingles"]).select(
        "doc_id", "n_shingles", F.col("_root").alias("component_id"))
    alone = marked.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
