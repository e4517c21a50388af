"""Synthetic tables and streams from a spec."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthloom.functions.draw import Draw
from synthloom.operators.link import bind_cross, pool_join
from synthloom.plans import spec as S
from synthloom.plans.compile import add_fields

ROWS_PER_PARTITION = 1_000_000


def synth(spark: SparkSession, spec: Any, n: int, seed: int = 0, start: int = 0, *,
          now: object = None, kind: str = "fast", scope: str = "",
          pools: dict[str, DataFrame] | None = None,
          dictionaries: dict[str, DataFrame] | None = None,
          partitions: int | None = None) -> DataFrame:
    """``n`` rows from a spec. Row i depends on (seed, i) only, so any slice can be rebuilt alone."""
    if n < 0:
        raise ValueError("n must not be negative")
    parts = partitions or max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_PARTITION))
    rows = spark.range(start, start + n, 1, parts)
    return synth_over(rows, spec, "id", seed, row="id", now=now, kind=kind, scope=scope,
                      pools=pools, dictionaries=dictionaries)


def synth_over(df: DataFrame, spec: Any, key: str, seed: int = 0, *, row: str | None = None,
               keep: list[str] | tuple[str, ...] = (), now: object = None, kind: str = "fast",
               scope: str = "", pools: dict[str, DataFrame] | None = None,
               dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """Synthesise one record per row of ``df``, its draws keyed by column ``key``.

    ``row`` is the 0-based row number used by stateful fields (default: the key itself).
    ``pools`` maps a pool name to its table; ``dictionaries`` maps a spec name to its assigned values.
    """
    node = spec if isinstance(spec, dict) and spec.get("_checked") else S.load(spec)
    draw = Draw(seed, scope, kind)
    fields = node["fields"]
    wanted: dict[str, list[str]] = {}
    for name, f in fields.items():
        if "depends_on_pool" in f:
            wanted.setdefault(f["depends_on_pool"], []).append(name)
    base = df.select(F.col(key).alias("_key"), F.col(row or key).alias("_row"),
                     *[F.col(k) for k in keep])
    for pool, names in wanted.items():
        if pool not in (pools or {}):
            raise S.SpecError(f"no table given for pool {pool!r}")
        base = pool_join(base, pools[pool], names, key="_key", draw=draw, pool_name=pool)
    given = tuple(n for names in wanted.values() for n in names)
    out = add_fields(base, node, draw, "_key", "_row", now, given)
    crossed: dict[tuple, list[str]] = {}
    for name, f in fields.items():
        if f.get("bound_to_schema"):
            crossed.setdefault(
                (f["bound_to_schema"], f["bound_to"], f.get("bound_to_revision")), []).append(name)
    for (schema, anchor, revision), names in crossed.items():
        if schema in (dictionaries or {}):
            out = bind_cross(out, dictionaries[schema], anchor, names, revision)
    return out.select(*keep, *[F.col(f"`{n}`") for n in fields])


def synth_stream(spark: SparkSession, spec: Any, rows_per_batch: int, seed: int = 0, *,
                 max_rows: int | None = None, now: object = None, kind: str = "fast",
                 scope: str = "", partitions: int | None = None, duration_ms: int | None = None,
                 batch_ms: int = 1000) -> DataFrame:
    """Unbounded rows from a spec, ``rows_per_batch`` per micro-batch, optionally capped.

    The source numbers rows 0, 1, 2, ... so a row equals the one ``synth`` makes for that number,
    and a restarted query continues where its checkpoint ends. Column ``seq`` carries the number.
    Every micro-batch is ``batch_ms`` of event time; ``duration_ms`` keeps the rows of that much. With the
    trigger ``availableNow`` a query makes one micro-batch and ends; started again, it makes the next one.
    """
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("advanceMillisPerBatch", batch_ms)
    if partitions:
        reader = reader.option("numPartitions", partitions)
    rows = reader.load().withColumnRenamed("value", "seq")
    if max_rows is not None:
        rows = rows.where(F.col("seq") < max_rows)
    if duration_ms is not None:
        rows = rows.where(F.unix_millis("timestamp") < duration_ms)
    return synth_over(rows, spec, "seq", seed, keep=["seq"], now=now, kind=kind, scope=scope)


class Engine:
    """Object form of the same API: ``Engine(spark, seed).table(spec, n)``."""

    def __init__(self, spark: SparkSession, seed: int = 0, kind: str = "fast") -> None:
        self.spark, self.seed, self.kind = spark, seed, kind

    def table(self, spec: Any, n: int, start: int = 0, **kw) -> DataFrame:
        return synth(self.spark, spec, n, self.seed, start, kind=self.kind, **kw)

    def stream(self, spec: Any, rows_per_batch: int, **kw) -> DataFrame:
        return synth_stream(self.spark, spec, rows_per_batch, self.seed, kind=self.kind, **kw)


def envelope(df: DataFrame, seq: str | Column, faults: str | None = None) -> DataFrame:
    """Wrap rows as events ``(type, seq, data, faults)``; ``seq`` is a dense 0-based number."""
    number = F.col(seq) if isinstance(seq, str) else seq
    hidden = {seq, faults}
    data = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in hidden]), {"ignoreNullFields": "false"})
    tags = F.col(faults) if faults else F.array().cast("array<string>")
    return df.select(F.lit("event").alias("type"), number.cast("bigint").alias("seq"),
                     data.alias("data"), tags.alias("faults"))
