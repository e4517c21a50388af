"""Rows made ahead of use: bounded materialisation, all-or-nothing reads, newest-N queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.session import top_per_key


def pregen_write(df: DataFrame, path: str, schema_col: str, row: str, max_items: int,
                 global_max_items: int | None = None, global_row: str | None = None,
                 records_per_file: int = 1_000_000) -> None:
    """Write prepared rows by schema, at most ``max_items`` per schema.

    ``row`` numbers rows within a schema from 0; ``global_row`` numbers them over all schemas when an
    overall cap is set. Both caps are plain filters, so capped rows are never produced.
    """
    kept = df.where(F.col(row) < max_items)
    if global_max_items is not None:
        kept = kept.where(F.col(global_row or row) < global_max_items)
    (kept.write.mode("append").option("maxRecordsPerFile", records_per_file)
     .partitionBy(schema_col).parquet(path))


def pregen_or_live(pregen: DataFrame, live: DataFrame, k: int, order: str,
                   require: bool = False) -> DataFrame:
    """Up to ``k`` prepared rows; live rows only if nothing is prepared (no top-up).

    With ``require`` an empty store is an error instead.
    """
    ready = pregen.orderBy(order).limit(k)
    empty = pregen.limit(1).agg(F.count("*").alias("n")).scalar() == 0
    other = live.select(*pregen.columns).orderBy(order).limit(k).where(empty)
    if require:
        stop = F.raise_error(F.lit("no prepared rows")).cast("boolean")
        other = live.select(*pregen.columns).limit(1).where(F.when(empty, stop).otherwise(False))
    return ready.unionByName(other)


def bounded_recent(df: DataFrame, key: str, order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """Only the newest ``n`` rows per key; ``order`` sorts newest first and must be unique."""
    return top_per_key(df, [key], order, n, salts)
