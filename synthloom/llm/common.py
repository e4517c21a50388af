"""Helpers that the training-data operators share: tables in the shared folder, Arrow slices, words."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.session import work_dir

SLICE_BYTES = 8 << 20  # texts handled at once inside a task


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let Arrow batches be bounded by bytes, so that very long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """Return unused memory to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def grouped_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each group of a stream that is sorted by its first column, without that column, a group at a time."""
    held, group = [], None
    for b in batches:
        for key, *row in zip(*[c.to_pylist() for c in b.columns]):
            if held and key != group:
                yield held
                held = []
            group = key
            held.append(tuple(row))
    if held:
        yield held


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    A collection on the driver then lets Spark delete the shuffle files of stages that nothing refers to any more.
    """
    spark, schema = df.sparkSession, df.schema
    path = work_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.range(1).count()  # the session refers to its last execution
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing reads any more; any other table stays as it is."""
    path = df.__dict__.pop("stored_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def text_slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(start, part) pieces of at most ``max_bytes`` (or one text); nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, done + max_bytes, side="right")))
        yield start, texts.slice(start, end - start)
        start, done = end, int(sizes[end - 1])
    give_back()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between the bytes 0x20 and 0x09-0x0D: (offsets per text, word codes, distinct words)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if empty >= 0:
        real = codes != empty
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(real, out=at[1:])
        offsets, codes = at[offsets - offsets[0]], codes[real]
    else:
        offsets = offsets - offsets[0]
    return offsets, codes, coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a public 64-bit mixing function)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def binary_list(parts: list) -> pa.Array:
    return pa.array([p.tobytes() if isinstance(p, np.ndarray) else p for p in parts], pa.binary())


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``SYNTHLOOM_TOKENIZERS`` may name another folder."""
    folder = os.environ.get("SYNTHLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)
