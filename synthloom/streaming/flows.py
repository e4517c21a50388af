"""Stream operators: faults on streams, late data, deduplication, resumable runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from synthloom.functions.draw import Draw
from synthloom.functions.times import SECOND
from synthloom.plans.fault_plan import FaultPlan, apply_plan
from synthloom.session import carried, islands


def stream_faults(sdf: DataFrame, plan: FaultPlan, draw: Draw, key: str) -> DataFrame:
    """Row-scoped faults are projections, so the same plan runs on a stream, each item on its own.

    A plan with ``forced`` operators hits every row of every micro-batch.
    """
    return apply_plan(sdf, plan, draw, key)


def each_batch(sdf: DataFrame, damage: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str,
               fmt: str = "parquet") -> StreamingQuery:
    """Batch-scoped operators on a stream: ``damage(batch, epoch)`` sees one whole micro-batch.

    Each epoch writes its own folder, so a replayed epoch overwrites itself instead of adding rows.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        damage(batch, epoch).write.mode("overwrite").format(fmt).save(f"{path}/epoch={epoch}")

    return (sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def late_filter(sdf: DataFrame, ts: str, watermark: str, window: str, keys: list[str] | None = None,
                slide: str | None = None, session_gap: str | None = None) -> DataFrame:
    """Counts per event-time window behind a watermark; rows later than that are dropped by state."""
    slot = (F.session_window(ts, session_gap) if session_gap
            else F.window(ts, window, slide) if slide else F.window(ts, window))
    return (sdf.withWatermark(ts, watermark).groupBy(slot.alias("slot"), *(keys or []))
            .agg(F.count("*").alias("rows"))
            .select(F.col("slot.start").alias("start"), F.col("slot.end").alias("end"), *(keys or []), "rows"))


def split_late(df: DataFrame, ts_us: str, arrival: str, delay_us: int, width: int = 65_536) -> DataFrame:
    """Batch twin: ``late`` marks rows more than the delay behind the newest time that arrived before."""
    rows = carried(df, [], F.floor(F.col(arrival) / F.lit(width)), {"_m": F.max(ts_us)}, {"_earlier": F.max("_m")})
    inside = W.partitionBy("_slice").orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    seen = F.greatest(F.col("_earlier"), F.max(ts_us).over(inside))
    return rows.withColumn("late", F.coalesce(F.col(ts_us) < seen - F.lit(delay_us), F.lit(False))).drop("_slice", "_earlier")


def window_counts(df: DataFrame, ts_us: str, size_us: int, slide_us: int | None = None) -> DataFrame:
    """On-time and late rows per tumbling or sliding window of the batch twin."""
    slide_us = slide_us or size_us
    last = F.floor(F.col(ts_us) / F.lit(slide_us)) * slide_us
    starts = F.sequence(last - (size_us - slide_us), last, F.lit(slide_us)) if size_us > slide_us else F.array(last)
    return (df.select(F.explode(starts).alias("start_us"), "late").groupBy("start_us")
            .agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late")))


def session_counts(df: DataFrame, ts_us: str, gap_s: int, keys: list[str]) -> DataFrame:
    """Batch twin of session windows: rows closer than the gap share a session.

    Rows of one moment are counted first; sessions are then islands of moments, found in time slices, so
    a key with most of the rows is not gathered in one task as a session-window aggregate would do.
    """
    gap = gap_s * SECOND
    moments = df.groupBy(*keys, ts_us).agg(F.count("*").alias("_n"))
    # a session window ends a gap after its last row and does not include its end
    marked = islands(moments, keys, ts_us, ts_us, gap - 1, width=16 * gap)
    return marked.groupBy(*keys, "_island").agg(
        F.min(ts_us).alias("start_us"), (F.max(ts_us) + gap).alias("end_us"),
        F.sum("_n").alias("rows")).drop("_island")


def stream_dedup(sdf: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """One row per key, whatever was sent twice within the watermark."""
    return sdf.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def batch_dedup(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Batch twin: the first row per key, kept map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*")


def resume(sdf: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Run (or continue) a stream over everything available: the checkpoint remembers what was sent."""
    return (sdf.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
