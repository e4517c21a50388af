"""Token shards: documents in ascending id order, tokenised and written as wavelet-matrix shard files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthloom.llm.common import set_batches, tasks_of, text_slices
from synthloom.llm.tokens import encoder, with_end
from synthloom.llm.wavelet import read_shard, write_shard
from synthloom.session import work_dir

SCHEMA = "part int, before long, n_tokens long, n_docs long, content binary"


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_tokens: int = 1 << 20,
                       id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Write one row per shard file (``content``) below ``path``.

    Documents are range-partitioned by id (nulls first, equal ids next to each other) and each task cuts its
    run into shards of about ``shard_tokens`` tokens; ``part`` and ``before`` order them. Null texts are empty.
    """
    spark = docs.sparkSession
    set_batches(spark)
    n = partitions or tasks_of(spark)
    ordered = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
               .repartitionByRange(n, F.col("_id").asc_nulls_first())
               .sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal before, held
            flat = np.concatenate(tokens)
            row = [[part], [before], [len(flat)], [len(ids)], [write_shard(ids, np.concatenate(sizes), flat)]]
            before, held = before + len(flat), 0
            ids.clear(), sizes.clear(), tokens.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["part", "before", "n_tokens", "n_docs", "content"])

        for b in batches:
            names = b.column("_id")
            for start, part_texts in text_slices(b.column("_text"), 2 << 20):
                flat, offsets = with_end(*encode(part_texts), end_id)
                ids += names.slice(start, len(part_texts)).to_pylist()
                sizes.append(np.diff(offsets))
                tokens.append(flat)
                held += len(flat)
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    ordered.mapInArrow(shards, SCHEMA).write.option("compression", "none").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shard files: doc_id, start, n_tokens and crc32 of its ids."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per task that wrote
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begin = sums.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for before, content in zip(b.column("_before").to_pylist(), b.column("content")):
                names, sizes, matrix = read_shard(content.as_py())
                flat = matrix.decode().astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(before + at[:-1], pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(begin), "part").select(
        (F.col("before") + F.col("_begin")).alias("_before"), "content")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the shards to the shared folder and read every document back from them."""
    spark = docs.sparkSession
    path = work_dir(spark, "token-shards")
    write_token_shards(docs, path, vocabulary, end_id)
    return read_token_shards(spark, path)
