"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours, which greedily fill windows.

Documents are dealt to tasks in the order of a content sketch, so that copies and texts with common passages
meet; every task indexes its documents shard by shard. A window starts with a seed document, takes the best
unused neighbours that fit, and cuts the best one when none fits; what is cut off seeds the next window.
The last tokens of a task are cut into windows whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import mix, set_batches, stored, tasks_of, text_slices
from synthloom.llm.tokens import encoder, with_end

K1, B = 1.2, 0.75
SHARD = 2048       # documents of an index shard
QUERY_TERMS = 24   # a seed's heaviest terms, which make its query
LOOK = 8           # neighbours tried for a gap before one is cut
SLICES = 16        # pieces in which document frequencies are summed


def term_rows(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs with how often the term stands there; the end id is no term."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    keys = (doc << 32) | ids.astype(np.int64)
    keys = np.sort(keys[ids != end_id])
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head] >> 32, keys[head] & 0xFFFFFFFF, np.diff(np.append(head, len(keys)))


def _sketch(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Smallest hash of the token triples of each text, so that texts with common passages often agree."""
    x = ids.astype(np.uint64)
    h = x.copy()
    for k in (1, 2):
        h[:-k] = h[:-k] * np.uint64(0x9E3779B97F4A7C15) + x[k:]
    return np.minimum.reduceat(mix(h), offsets[:-1]).view(np.int64)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (ids, sketch), and per batch rows of partial document frequencies."""
    schema = "kind int, doc_id long, n_tokens long, sketch long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        terms = encode.whole.get_vocab_size()
        frequency = np.zeros(-(-terms // SLICES) * SLICES, np.int64)
        for b in batches:
            at = 0
            for _, part in text_slices(b.column("text"), 4 << 20):
                n = len(part)
                ids, offsets = with_end(*encode.encode(part), end_id)
                frequency += np.bincount(term_rows(ids, offsets, end_id)[1], minlength=len(frequency))
                kind = np.uint16 if terms <= 1 << 16 else np.uint32
                raw = ids.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), b.column("doc_id").slice(at, n), pa.array(np.diff(offsets)),
                     pa.array(_sketch(ids, offsets)),
                     pa.array([raw[s:e].tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())],
                    ["kind", "doc_id", "n_tokens", "sketch", "ids"])
                at += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(SLICES, np.int32)), pa.array(np.arange(SLICES)), pa.array(np.zeros(SLICES, np.int64)),
             pa.array(np.zeros(SLICES, np.int64)), pa.array([p.tobytes() for p in np.split(frequency, SLICES)], pa.binary())],
            ["kind", "doc_id", "n_tokens", "sketch", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Sum of the partial frequencies, of the size of the vocabulary."""
    def add(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in got["ids"])
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.where("kind = 1").select(F.col("doc_id").alias("slice"), "ids").groupBy("slice").applyInArrow(
        add, "slice long, sums binary").toArrow().sort_by("slice")
    return np.concatenate([np.frombuffer(x, np.int64) for x in parts["sums"].to_pylist()]) if len(parts) else np.zeros(1, np.int64)


class Shard:
    """Inverted index of some documents with BM25 weights from corpus-wide statistics."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, idf: np.ndarray, mean: float, end_id: int) -> None:
        doc, term, times = term_rows(ids, offsets, end_id)
        self.n = len(offsets) - 1
        norm = K1 * (1 - B + B * np.diff(offsets) / mean)
        weight = (idf[term] * times * (K1 + 1) / (times + norm[doc])).astype(np.float32)
        self.first = np.searchsorted(doc, np.arange(self.n + 1))  # a document's own terms
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.terms, self.post_at = np.unique(term[order], return_index=True)
        self.post_at = np.append(self.post_at, len(order))
        self.unused = np.ones(self.n, bool)

    def neighbours(self, seed: int, count: int) -> list[int]:
        """The best unused documents for a seed, best first; those that share no query term are left out."""
        own = slice(self.first[seed], self.first[seed + 1])
        term, weight = self.term[own], self.weight[own]
        if len(term) > QUERY_TERMS:
            term = term[np.argpartition(-weight, QUERY_TERMS)[:QUERY_TERMS]]
        if not len(term):
            return []
        at = np.searchsorted(self.terms, term)
        runs = list(zip(self.post_at[at].tolist(), self.post_at[at + 1].tolist()))
        docs = np.concatenate([self.post_doc[s:e] for s, e in runs])
        score = np.bincount(docs, np.concatenate([self.post_weight[s:e] for s, e in runs]), self.n)
        score *= self.unused
        top = np.argpartition(-score, count)[:count] if self.n > count else np.arange(self.n)
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))].tolist()


class Packer:
    """Fills windows with pieces; keeps what is begun between shards of a task."""

    def __init__(self, length: int, base: int) -> None:
        self.length, self.sequence, self.used = length, base, 0
        self.open: list[tuple] = []   # pieces of the window that is being filled
        self.done: list[tuple] = []   # (document, start, length, sequence, offset)

    @property
    def room(self) -> int:
        return self.length - self.used

    def put(self, doc, start: int, size: int) -> None:
        self.open.append((doc, start, size, self.sequence, self.used))
        self.used += size
        if self.used == self.length:
            self.done += self.open
            self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def fill(self, doc, start: int, end: int) -> None:
        """Place tokens start..end, over as many windows as they need."""
        while start < end:
            size = min(end - start, self.room)
            self.put(doc, start, size)
            start += size

    def finish(self) -> None:
        """Cut what is begun into windows that are powers of two long."""
        left, self.open = self.open, []
        rest, self.used = self.used, 0
        bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        for doc, start, size, _, _ in left:
            while size:
                part = min(size, bits[0] - self.used)
                self.done.append((doc, start, part, self.sequence, self.used))
                self.used, start, size = self.used + part, start + part, size - part
                if self.used == bits[0]:
                    bits.pop(0)
                    self.used, self.sequence = 0, self.sequence + 1


def pack_shard(shard: Shard, sizes: np.ndarray, packer: Packer, names: list) -> None:
    """Place every document of a shard: seeds in order, neighbours by retrieval."""
    unused, seed = shard.unused, -1
    for first in range(shard.n):
        if not unused[first]:
            continue
        unused[first] = False
        packer.fill(names[first], 0, int(sizes[first]))
        seed = first
        while packer.used:  # the window that holds the seed's end
            near = shard.neighbours(seed, LOOK)
            if not near:
                break
            placed = False
            for d in near:
                if sizes[d] <= packer.room and packer.used:
                    unused[d] = False
                    packer.fill(names[d], 0, int(sizes[d]))
                    placed = True
            if not placed:
                best = near[0]
                unused[best] = False
                packer.fill(names[best], 0, int(sizes[best]))
                seed = best  # its rest begins the next window


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id",
                   text_col: str = "text", partitions: int | None = None, tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text has the end id only. Rows that repeat an id are documents of their own; a null id is kept.
    ``tokens`` adds each piece's ids as an array.
    """
    spark = docs.sparkSession
    set_batches(spark)
    rows = stored(tokenised(docs, vocabulary, end_id, id_col, text_col), "token-ids")
    whole = rows.where("kind = 0")
    count, total = whole.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    frequency = document_frequencies(rows)
    idf = np.log1p((count - frequency + 0.5) / (frequency + 0.5))
    mean = max(1.0, (total - count) / max(1, count))
    wide = len(frequency) > 1 << 16
    n = partitions or tasks_of(spark)
    ordered = (whole.select("doc_id", "sketch", "ids")
               .repartitionByRange(n, "sketch", F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions("sketch", F.col("doc_id").asc_nulls_first(), "ids"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{c} long" for c in names) + (", ids array<int>" if tokens else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, TaskContext.get().partitionId() << 32)
        held: dict[int, tuple] = {}   # documents with pieces that are not given out yet
        serial = 0

        def out() -> Iterator[pa.RecordBatch]:
            done, packer.done = packer.done, []
            if done:
                crc, arrays = [], []
                for d, start, size, _, _ in done:
                    own = held[d][1][start:start + size]
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    if tokens:
                        arrays.append(own.astype(np.int32))
                own = [held[p[0]] for p in done]
                columns = [[o[0] for o in own], [p[1] for p in done], [p[2] for p in done], crc,
                           [len(o[1]) for o in own], [p[3] for p in done], [p[4] for p in done]]
                arrays = [pa.array(arrays, pa.list_(pa.int32()))] if tokens else []
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + arrays,
                                                 names + ["ids"] * tokens)
            live = {p[0] for p in packer.open}
            for d in [d for d in held if d not in live]:
                del held[d]

        def shard(part: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            keys = list(range(serial, serial + len(part)))
            serial += len(part)
            held.update(zip(keys, part))
            sizes = np.array([len(p[1]) for p in part])
            index = Shard(np.concatenate([p[1] for p in part]), np.concatenate([[0], np.cumsum(sizes)]), idf, mean, end_id)
            pack_shard(index, sizes, packer, keys)
            yield from out()

        waiting: list[tuple] = []
        kind = np.uint32 if wide else np.uint16
        for b in batches:
            for name, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                waiting.append((name, np.frombuffer(raw, kind)))
                if len(waiting) == SHARD:
                    yield from shard(waiting)
                    waiting = []
        if waiting:
            yield from shard(waiting)
        packer.finish()
        yield from out()

    return ordered.mapInArrow(run, schema)
