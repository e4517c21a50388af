"""Datasets: batches of rows stored as one JSON document each, and read back as rows."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 1_000
COLUMNS = ("id", "schema_name", "data", "metadata", "seed", "chaos_applied", "created_at", "expires_at")


@dataclass(frozen=True)
class DatasetMeta:
    """What all datasets of one append share."""

    seed: int | None
    created: dt.datetime
    spec: Any = None
    faults: list[str] = field(default_factory=list)
    ttl_days: int = 30
    append: str | None = None  # names this append; by default the time it was created at


def dataset_append(df: DataFrame, meta: DatasetMeta, schema_col: str, seq: str,
                   batch_size: int = MAX_ITEMS) -> DataFrame:
    """Group rows into datasets of at most ``batch_size`` items, in ``seq`` order.

    ``seq`` is a dense 0-based number within the schema, so a group never exceeds ``batch_size`` rows.
    The id is a hash of (schema, seed, append, batch): a retried append writes the same ids, another append
    of the same schema and seed writes new ones. Other columns become the JSON of the item, nulls included.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    append = meta.append or meta.created.isoformat()
    item = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (schema_col, seq)]),
                     {"ignoreNullFields": "false"})  # null and missing are not the same
    rows = df.select(F.col(schema_col).alias("schema_name"), F.col(seq).alias("_seq"), item.alias("_item"),
                     F.floor(F.col(seq) / F.lit(batch_size)).alias("_batch"))
    grouped = rows.groupBy("schema_name", "_batch").agg(
        F.array_sort(F.collect_list(F.struct("_seq", "_item"))).alias("_items"))
    texts = F.array_join(F.transform("_items", lambda x: x["_item"]), ",")
    spec_hash = F.substring(F.sha2(F.lit(json.dumps(meta.spec, sort_keys=True)), 256), 1, 16)
    created = F.lit(meta.created.replace(tzinfo=meta.created.tzinfo or dt.timezone.utc))
    return grouped.select(
        F.md5(F.concat_ws("|", "schema_name", F.lit(str(meta.seed)), F.lit(append), "_batch")).alias("id"),
        F.col("schema_name"),
        F.concat(F.lit('{"items":['), texts, F.lit("]}")).alias("data"),
        F.create_map(F.lit("spec_hash"), spec_hash).alias("metadata"),
        F.lit(meta.seed).cast("bigint").alias("seed"),
        F.array(*[F.lit(f) for f in meta.faults]).cast("array<string>").alias("chaos_applied"),
        created.alias("created_at"),
        (created + F.make_interval(days=F.lit(meta.ttl_days))).alias("expires_at"))


def read_items(datasets: DataFrame, item_schema: str, dataset_id: str | None = None) -> DataFrame:
    """Items of one dataset (or all) as rows, with the dataset id."""
    chosen = datasets if dataset_id is None else datasets.where(F.col("id") == dataset_id)
    parsed = F.from_json("data", f"struct<items:array<struct<{item_schema}>>>")
    return (chosen.select("id", F.explode(parsed["items"]).alias("_item"))
            .select("id", "_item.*"))
