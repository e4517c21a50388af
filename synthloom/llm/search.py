"""Ranked lexical search over a document-partitioned inverted index, term-at-a-time and document-at-a-time.

The index is a table of postings by block of documents and term. A query's short lists in a
block are summed term by term into accumulators, which then stand beside the long lists as one more iterator with a
bound of its own. Document windows are walked in order; lists whose bounds together cannot reach the current k-th
score are not walked but only probed at documents that can. Scores are 64-bit integers, so they do not depend on order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from synthloom.llm.common import set_batches, split_words, stored, text_slices
from synthloom.session import top_per_key

BLOCK_BYTES = 24 << 20     # text of a block; a longer text is a block of its own
PACKET_TERMS = 200_000     # query terms that travel to the tasks at once
SHORT = 32                 # a list is short below a block's documents over this
WINDOW = 1024              # documents that are walked between two looks at the threshold
NO_ID = np.iinfo(np.int64).min  # stands for a null id inside tasks; null ids rank before all others

# Bytes of terms (ASCII digits and letters, all of non-ASCII characters) with A-Z lowered; the rest become spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX = "block long, term string, n int, places binary, counts binary"
HEAD = ""                  # the row with this term holds a block's ids and lengths; no term is empty


def split_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets per text, term codes, distinct terms)."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int32)
    body = texts.buffers()[2]
    data = body[int(at[0]):int(at[-1])].to_pybytes().translate(TERM_BYTES) if body is not None else b""
    plain = pa.StringArray.from_buffers(n, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(data))
    return split_words(plain, lower=False)


def _block(block: int, ids: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Index rows of a block; its documents in ascending order of id."""
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], texts.take(pa.array(order))
    offsets, codes, terms = split_terms(texts)
    sizes = np.diff(offsets)
    n = max(1, len(ids))
    key, count = np.unique(codes.astype(np.int64) * n + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    starts = np.searchsorted(key, np.arange(len(terms) + 1) * n)
    places, count = (key % n).astype(np.int32), count.astype(np.int32)
    yield _rows(block, pa.array([HEAD]), np.array([0, len(ids)]), ids, sizes.astype(np.int64))
    for low in range(0, len(terms), 4096):
        part = starts[low:low + 4097]
        own = _rows(block, terms.slice(low, 4096), part - part[0], places[part[0]:part[-1]], count[part[0]:part[-1]])
        yield own.filter(pc.greater(own.column("n"), 0))  # the dictionary may hold the empty text between two spaces


def _rows(block: int, terms: pa.Array, starts: np.ndarray, places: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    ends = pa.py_buffer((starts * places.itemsize).astype(np.int32))
    cells = [pa.BinaryArray.from_buffers(pa.binary(), len(terms), [None, ends, pa.py_buffer(np.ascontiguousarray(x))]) for x in (places, counts)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), block)), terms, pa.array(np.diff(starts).astype(np.int32)), *cells],
                                      ["block", "term", "n", "places", "counts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index as a stored table: a row for each block of documents and term, and one with the block's ids and lengths.

    A null text has no terms; null ids are kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            own = pc.fill_null(b.column("id"), int(NO_ID)).to_numpy()
            for start, part in text_slices(b.column("text"), block_bytes):
                size = pc.sum(pc.binary_length(part)).as_py() or 0
                if held and held + size > block_bytes:
                    yield from _block(block, np.concatenate(ids), pa.concat_arrays(parts))
                    ids, parts, held, block = [], [], 0, block + 1
                ids.append(own[start:start + len(part)])
                parts.append(part)
                held += size
        if ids:
            yield from _block(block, np.concatenate(ids), pa.concat_arrays(parts))

    set_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, INDEX), "search-index")


def index_totals(index: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in b.column("counts").to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], ["texts", "terms"])

    heads = index.where(F.col("term") == HEAD).select("counts").mapInArrow(run, "texts long, terms long")
    return tuple(heads.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


@dataclass
class Packet:
    """A block of queries: their distinct terms and, per query, the places of its terms."""

    rows: list[int]              # query number
    terms: list[str]
    of: list[np.ndarray]


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, query, terms): each row of ``items`` is a query with a number of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for _, part in text_slices(b.column("text")):
                offsets, codes, terms = split_terms(part)
                lists = [np.unique(codes[offsets[i]:offsets[i + 1]]) for i in range(len(part))]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = terms.take(pa.array(np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("query").slice(done, len(part)), pa.ListArray.from_arrays(pa.array(ends), flat)],
                                                 ["query", "terms"])
                done += len(part)

    numbered = stored(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).withColumn(
        "query", F.monotonically_increasing_id()), "queries")
    return numbered.drop("text"), stored(numbered.select("query", "text").mapInArrow(run, "query long, terms array<string>"), "query-terms")


def packets(queries: DataFrame, limit: int) -> Iterator[Packet]:
    """Queries in blocks of at most ``limit`` terms (or one query), one partition at a time on the driver."""
    rows, lists, held = [], [], 0
    def packet() -> Packet:
        distinct = {t: i for i, t in enumerate(sorted({t for ts in lists for t in ts}))}
        return Packet(rows, list(distinct), [np.array([distinct[t] for t in ts], np.int64) for ts in lists])
    for r in queries.where(F.size("terms") > 0).toLocalIterator():
        if rows and held + len(r["terms"]) > limit:
            yield packet()
            rows, lists, held = [], [], 0
        rows.append(r["query"])
        lists.append(r["terms"])
        held += len(r["terms"])
    if rows:
        yield packet()


def term_table(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(term, t) of a packet's terms and the head's (-1); its size is bounded by the packet."""
    return F.broadcast(spark.createDataFrame(pa.table({"term": pa.array([HEAD, *terms]), "t": pa.array(np.arange(-1, len(terms)))})))


def document_counts(index: DataFrame, terms: list[str]) -> np.ndarray:
    """How many documents hold each term."""
    out = np.zeros(len(terms), np.int64)
    known = index.select("term", "n").join(term_table(index.sparkSession, terms), "term").where("t >= 0")
    sums = known.groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out[sums["t"].to_numpy()] = sums["n"].to_numpy()
    return out


class Best:
    """The k best (score, id) of a query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """Least score that may still enter; an equal score may, by its id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.id = score[order], ids[order]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Short lists summed term by term: one list of documents and scores."""
    docs, at = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, at, np.concatenate([s for _, s in lists]))
    return docs, sums


def walk(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: np.ndarray, best: Best, short: float, window: int = WINDOW) -> None:
    """Bring a block's documents into ``best``. ``lists`` are (documents ascending, scores)."""
    few = [x for x in lists if len(x[0]) <= short]
    runs = [x for x in lists if len(x[0]) > short] + ([accumulate(few)] if few else [])
    bounds = np.array([int(s.max()) for _, s in runs], np.int64)
    order = np.argsort(bounds, kind="stable")
    runs, upto = [runs[i] for i in order], np.concatenate([[0], np.cumsum(bounds[order])])
    at = [0] * len(runs)
    low = 0
    while low < n_docs:
        floor = best.floor
        first = int(np.searchsorted(upto, floor)) - 1  # runs before it cannot reach the floor together
        if first >= len(runs):
            return
        for r in range(first, len(runs)):
            at[r] += int(np.searchsorted(runs[r][0][at[r]:], low))
        low = min((int(runs[r][0][at[r]]) for r in range(first, len(runs)) if at[r] < len(runs[r][0])), default=n_docs)
        if low >= n_docs:
            return
        high = min(n_docs, low + window)
        sums = np.zeros(high - low, np.int64)
        for r in range(first, len(runs)):
            docs, scores = runs[r]
            end = at[r] + int(np.searchsorted(docs[at[r]:], high))
            sums[docs[at[r]:end] - low] += scores[at[r]:end]
            at[r] = end
        live = np.flatnonzero((sums > 0) & (sums + upto[first] >= floor))
        sums = sums[live]
        for r in range(first - 1, -1, -1):
            if not len(live):
                break
            docs, scores = runs[r]
            place = np.minimum(np.searchsorted(docs, live + low), len(docs) - 1)
            sums = sums + np.where(docs[place] == live + low, scores[place], 0)
            good = sums + upto[r] >= floor
            live, sums = live[good], sums[good]
        if len(live):
            best.add(sums, ids[live + low])
        low = high


def search_packet(index: DataFrame, packet: Packet, total: int, n_terms: int, k: int) -> DataFrame:
    """(query, id, score): at most k rows per query and task."""
    df = document_counts(index, packet.terms)
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((packet, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        best = [Best(k) for _ in own.rows]
        for rows in _blocks(batches):
            ids, sizes = (np.frombuffer(x, np.int64) for x in rows.pop(-1))
            m = 100 - 50 + (50 * sizes * total) // n_terms
            lists = {}
            for t, (places, counts) in rows.items():
                docs, tf = np.frombuffer(places, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
                lists[t] = docs, w[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
            for top, terms in zip(best, own.of):
                mine = [lists[t] for t in terms.tolist() if t in lists and w[t] > 0]
                if mine:
                    walk(mine, len(ids), ids, top, max(1.0, len(ids) / SHORT))
        sizes = [len(x.score) for x in best]
        ids = np.concatenate([np.zeros(0, np.int64), *(x.id for x in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(own.rows, np.int64), sizes)), pa.array(ids, mask=ids == NO_ID),
             pa.array(np.concatenate([np.zeros(0, np.int64), *(x.score for x in best)]))], ["query", "id", "score"])

    known = index.join(term_table(index.sparkSession, packet.terms), "term").select("block", "t", "places", "counts")
    return known.repartition("block").sortWithinPartitions("block").mapInArrow(run, "query long, id long, score long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[bytes, bytes]]]:
    """Rows of one block after the other: places and counts by term."""
    at, held = None, {}
    for b in batches:
        for block, t, places, counts in zip(*(b.column(c).to_pylist() for c in ("block", "t", "places", "counts"))):
            if block != at and held:
                yield held
                held = {}
            at = block
            held[t] = places, counts
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", query_col: str = "text", packet_terms: int = PACKET_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of each row of ``items``.

    Null texts have no terms; items without terms, and empty tables, give no rows. A repeated item is searched as often
    as it is there; repeated documents rank one after the other; null doc ids rank before others of the same score.
    """
    spark: SparkSession = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    total, n_terms = index_totals(index)
    names, queries = query_terms(items, item_col, query_col)
    found = spark.createDataFrame([], "query long, id long, score long")
    if total:
        for packet in packets(queries, packet_terms):
            part = search_packet(index, packet, total, n_terms, k)
            found = found.unionByName(stored(top_per_key(part, ["query"], [F.desc("score"), F.asc_nulls_first("id")], k), "found"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    return found.withColumn("rank", rank).join(names, "query").select(
        F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def search_sql(k: int = 50) -> str:
    """DuckDB SQL for the rows of ``ranked_search`` over documents and benchmark."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
    WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {letters}), '{pattern}') AS ts FROM documents),
    sized AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM words WHERE len(ts) > 0),
    total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized),
    posts AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM words) GROUP BY r, t),
    asked AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {letters}), '{pattern}')) AS t
              FROM (SELECT row_number() OVER () AS q, * FROM benchmark)),
    dfs AS (SELECT t, count(*)::BIGINT AS df FROM posts WHERE t IN (SELECT t FROM asked) GROUP BY t),
    weights AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, total),
    lengths AS (SELECT r, doc_id, 100 - 50 + (50 * n * nn) // ll AS m FROM sized, total),
    sums AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
             FROM asked JOIN weights USING (t) JOIN posts USING (t) JOIN lengths USING (r) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS FIRST) AS rank FROM sums WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
