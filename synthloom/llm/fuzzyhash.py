"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever its lowest ``k`` bits are all ones, so a chunk's
end depends on its neighbourhood only. Each chunk gives one of 64 letters. A fingerprint holds the signatures
for block sizes 2**k and 2**(k+1); two fingerprints are compared by edit distance where block sizes meet.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import mix, set_batches, tasks_of, text_slices

ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
LONGEST, ENOUGH = 64, 32   # letters of a signature, and the least that a block size should give
WINDOW, RUN = 7, 5         # bytes of the rolling hash; letters two signatures must share in a row
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        full = np.full(n, BASE, np.uint64)
        full[0] = 1
        _POWERS = np.cumprod(full)
    return _POWERS[:n]


def _inverse_power(at: np.ndarray) -> np.ndarray:
    """BASE**-at modulo 2**64, by repeated squaring."""
    out, square, rest = np.ones(len(at), np.uint64), np.full(1, pow(BASE, -1, 1 << 64), np.uint64), at.astype(np.uint64)
    while rest.any():
        out = np.where(rest & np.uint64(1), out * square, out)
        square, rest = square * square, rest >> np.uint64(1)
    return out


@dataclass
class Prints:
    """Fingerprints of many texts: block size exponent and two signatures of letters 0..63 each."""

    k: np.ndarray
    letters: tuple[np.ndarray, np.ndarray]   # (n, LONGEST) each
    sizes: tuple[np.ndarray, np.ndarray]

    def text(self) -> list[str]:
        table = np.frombuffer(ALPHABET.encode(), np.uint8)
        a, b = (["%s" % bytes(r[:n]).decode() for r, n in zip(table[x], s.tolist())]
                for x, s in zip(self.letters, self.sizes))
        return [f"{k}:{x}:{y}" for k, x, y in zip(self.k.tolist(), a, b)]

    def take(self, rows) -> Prints:
        return Prints(self.k[rows], tuple(x[rows] for x in self.letters), tuple(x[rows] for x in self.sizes))

    @staticmethod
    def join(parts: list[Prints]) -> Prints:
        return Prints(np.concatenate([p.k for p in parts]),
                      tuple(np.concatenate([p.letters[i] for p in parts]) for i in (0, 1)),
                      tuple(np.concatenate([p.sizes[i] for p in parts]) for i in (0, 1)))


def _slice_prints(texts: pa.Array) -> Prints:
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    total = len(raw)
    where = np.arange(total) - np.repeat(starts, sizes)  # position inside the text
    roll = np.zeros(total, np.uint32)
    factor = 1
    for back in range(WINDOW):
        own = raw[:total - back].astype(np.uint32) * np.uint32(factor) if back < total else np.zeros(0, np.uint32)
        if back:
            own *= where[back:] >= back
        roll[back:] += own
        factor = factor * 0x01000193 & 0xFFFFFFFF
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x2C1B3C6D)
    roll ^= roll >> np.uint32(13)
    level = np.bitwise_count(roll & ~(roll + np.uint32(1))).astype(np.uint8)  # trailing ones
    prefix = np.zeros(total + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(max(total, 1))[:total], out=prefix[1:])

    k = np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / LONGEST))).astype(np.int64)
    text_of = np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.bincount(text_of.astype(np.int64) * 33 + level, minlength=n * 33).reshape(n, 33)
    above = counts[:, ::-1].cumsum(1)[:, ::-1]  # boundaries with at least that level
    while True:
        few = (k > 0) & (above[np.arange(n), np.minimum(k, 32)] < ENOUGH)
        if not few.any():
            break
        k[few] -= 1

    letters, lengths = [], []
    for plus in (0, 1):
        ends_chunk = level >= (k + plus)[text_of] if total else np.zeros(0, bool)
        if total:
            ends_chunk[ends[sizes > 0] - 1] = True
        at = np.flatnonzero(ends_chunk)
        doc = text_of[at]
        first = np.searchsorted(doc, np.arange(n))
        rank = np.arange(len(at)) - first[doc]
        many = np.bincount(doc, minlength=n)
        # the last letter of a full signature covers the rest of the text
        keep = (rank < LONGEST - 1) | (rank == many[doc] - 1)
        at, doc, rank = at[keep], doc[keep], np.minimum(rank[keep], LONGEST - 1)
        begin = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
        value = (prefix[at + 1] - prefix[begin]) * _inverse_power(begin)
        grid = np.zeros((n, LONGEST), np.uint8)
        grid[doc, rank] = (mix(value) >> np.uint64(58)).astype(np.uint8)
        letters.append(grid)
        lengths.append(np.bincount(doc, minlength=n))
    return Prints(k, tuple(letters), tuple(lengths))


def prints(texts: pa.Array) -> Prints:
    """Fingerprints of whole texts; null is empty."""
    parts = [_slice_prints(part) for _, part in text_slices(texts, 2 << 20)]
    return Prints.join(parts) if parts else _slice_prints(pa.array([], pa.string()))


def edit_distance(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs of signatures, bit-parallel over the first and in step over the second."""
    n = len(a)
    one, full = np.uint64(1), ~np.uint64(0)
    where = np.zeros((n, 64), np.uint64)
    rows = np.arange(n)
    for j in range(LONGEST):
        use = j < na
        where[rows[use], a[use, j]] |= one << np.uint64(j)
    top = np.where(na > 0, one << (np.maximum(na, 1) - 1).astype(np.uint64), np.uint64(0))
    plus, minus, score = np.full(n, full), np.zeros(n, np.uint64), na.astype(np.int64).copy()
    for j in range(int(nb.max()) if n else 0):
        use = j < nb
        eq = where[rows, b[:, j]]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus), plus & xh
        score += np.where(use, ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0), 0)
        ph, mh = (ph << one) | one, mh << one
        plus, minus = np.where(use, mh | ~(xv | ph), plus), np.where(use, ph & xv, minus)
    return np.where(na == 0, nb, score)


def _like(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    longest = np.maximum(na, nb)
    near = 1 - edit_distance(a, na, b, nb) / np.maximum(longest, 1)
    long = np.flatnonzero((np.minimum(na, nb) >= RUN) & (near < 1))
    for i, x, y in zip(long.tolist(), a[long], b[long]):  # unlike texts share letters, but hardly a run of them
        x, y = bytes(x[:na[i]]), bytes(y[:nb[i]])
        own = {x[k:k + RUN] for k in range(len(x) - RUN + 1)}
        if not any(y[k:k + RUN] in own for k in range(len(y) - RUN + 1)):
            near[i] = 0.0
    return np.where(longest == 0, 1.0, near)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """0 to 1 for each pair: the best of the signatures with equal block sizes, 0 where none are equal."""
    out = np.zeros(len(a.k))
    for i in (0, 1):
        for j in (0, 1):
            rows = np.flatnonzero(a.k + i == b.k + j)
            if len(rows):
                near = _like(a.letters[i][rows], a.sizes[i][rows], b.letters[j][rows], b.sizes[j][rows])
                out[rows] = np.maximum(out[rows], near)
    return out


def fingerprint(text: Column | str) -> Column:
    """Fingerprint of each text as ``k:signature:signature``."""
    @F.arrow_udf("string")
    def own(texts: pa.Array) -> pa.Array:
        return pa.array(prints(texts).text(), pa.string())
    return own(text)


def fingerprint_likeness(left: Column | str, right: Column | str) -> Column:
    """Likeness of two fingerprint columns; null where either is null."""
    def parse(column: pa.Array) -> Prints:
        code = np.zeros(256, np.uint8)
        code[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(64)
        k, letters, sizes = [], ([], []), ([], [])
        for p in column.to_pylist():
            exponent, *both = (p or "0::").split(":")
            k.append(int(exponent))
            for i, s in enumerate(both):
                row = np.zeros(LONGEST, np.uint8)
                row[:len(s)] = code[np.frombuffer(s.encode(), np.uint8)]
                letters[i].append(row)
                sizes[i].append(len(s))
        return Prints(np.array(k), tuple(np.array(x) for x in letters), tuple(np.array(x) for x in sizes))

    @F.arrow_udf("double")
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.float64())
        near = likeness(parse(a), parse(b))
        return pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pa.array(near), pa.scalar(None, pa.float64()))
    return compare(left, right)


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, halo, id, text) sorted so that each row's successor by id directly follows it.

    Ids are cut into ranges at sampled quantiles; a range's first rows are repeated as ``halo`` at the end of
    the range before it (the first range's at the end of the last). Only range limits reach the driver. Null
    ids come first, equal ids go by text. One shuffle of the texts.
    """
    spark = docs.sparkSession
    n = tasks_of(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    limits = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"]
    cuts = np.unique(np.array(limits or [], np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(cuts, pc.fill_null(ids, -2**63).to_numpy(zero_copy_only=False), side="right")
        return pa.array(at.astype(np.int32))

    least = {r["b"]: r["least"] for r in rows.select(range_of("id").alias("b"), "id").groupBy("b").agg(
        F.when(F.count("*") > F.count("id"), F.lit(None)).otherwise(F.min("id")).alias("least")).collect()}
    order = sorted(least)
    firsts = {b: order[i - 1] for i, b in enumerate(order)}  # the range before; of the first, the last
    known = [F.lit(int(v)) for v in least.values() if v is not None]
    starts = F.col("id").isin(*known) if known else F.lit(False)
    if None in least.values():
        starts = starts | F.col("id").isNull()
    ranged = rows.withColumn("bucket", range_of("id")).withColumn("starts", starts)
    before = F.create_map(*[F.lit(x) for b, p in firsts.items() for x in (b, p)]) if firsts else None
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("halo"))
    if before is None:
        copies = F.array(here)
    else:
        copies = F.when(F.col("starts"), F.array(here, F.struct(before[F.col("bucket")].alias("bucket"),
                                                                F.lit(1).alias("halo")))).otherwise(F.array(here))
    spread = ranged.select(F.explode(copies).alias("c"), "id", "text").select("c.bucket", "c.halo", "id", "text")
    return spread.repartitionById(max(n, len(order), 1), "bucket").sortWithinPartitions(
        "bucket", "halo", F.col("id").asc_nulls_first(), "text")


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edit: its last quarter replaced by the next text's beginning.

    One result per row; a null text is empty, a null id comes before all others, rows with equal ids follow
    each other by text, and the only row of a table is its own successor.
    """
    set_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            for start, part in text_slices(batch.column("text"), 2 << 20):
                cut = [batch.column(c).slice(start, len(part)).to_pylist() for c in ("bucket", "halo", "id")]
                rows = list(zip(*cut, part.to_pylist()))
                if last is not None:
                    rows.insert(0, last)
                last = rows[-1]
                pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:])]
                use = [i for i, (x, _) in enumerate(pairs) if x[1] == 0]
                if not use:
                    continue
                edited = []
                for i in use:
                    (_, _, _, text), (_, _, _, after) = pairs[i]
                    quarter = len(text) // 4
                    edited.append(text[:len(text) - quarter] + after[:quarter])
                own = prints(pa.array([r[3] for r in rows], pa.string()))
                new = prints(pa.array(edited, pa.string()))
                at = np.array(use)
                mine, following = own.take(at), own.take(at + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[i][2] for i in use], pa.int64()), pa.array([len(rows[i][3]) for i in use], pa.int64()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(mine.text()),
                     pa.array(new.text()), pa.array(likeness(mine, new)), pa.array(likeness(mine, following))],
                    [c.split()[0] for c in OUT.split(", ")])

    return beside_next(docs, id_col, text_col).mapInArrow(run, OUT)
