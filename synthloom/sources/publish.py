"""Publishing rows as JSON messages to a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def messages(df: DataFrame, topic: str | Column, row: str, batch_size: int = 1_000,
             max_bytes: int | None = None) -> DataFrame:
    """Rows as ``(topic, batch, value, ok)``, nulls included; a message above ``max_bytes`` is not ok."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    name = F.lit(topic) if isinstance(topic, str) else topic
    made = df.select(name.alias("topic"), F.floor(F.col(row) / F.lit(batch_size)).alias("batch"),
                     value.alias("value"))
    return made.withColumn("ok", F.lit(True) if max_bytes is None else F.octet_length("value") <= max_bytes)


def report(msgs: DataFrame) -> DataFrame:
    """Messages sent and failed and batches used, per topic. Counted per batch first."""
    per_batch = msgs.groupBy("topic", "batch").agg(
        F.count_if("ok").alias("sent"), F.count_if(~F.col("ok")).alias("failed"))
    return per_batch.groupBy("topic").agg(
        F.sum("sent").alias("sent"), F.sum("failed").alias("failed"), F.count("*").alias("batches"))


def publish(df: DataFrame, topic: str | Column, row: str, batch_size: int = 1_000, fmt: str = "kafka",
            path: str | None = None, max_bytes: int | None = None, dead_letters: str | None = None,
            **options: str) -> DataFrame:
    """Send rows and return the report. ``fmt`` is any Spark sink: kafka, json, parquet, ...

    No row is left out: with ``max_bytes`` (a broker's limit), larger messages are written as Parquet to
    ``dead_letters``, which must then be given.
    """
    if max_bytes is not None and dead_letters is None:
        raise ValueError("max_bytes needs a dead_letters path for larger messages")
    msgs = messages(df, topic, row, batch_size, max_bytes)
    out = msgs.where("ok").select("topic", "value").write.format(fmt).options(**options)
    if fmt == "kafka":
        out.save()
    else:
        out.mode("append").partitionBy("topic").save(path)
    if dead_letters is not None:
        msgs.where("NOT ok").select("topic", "batch", "value").write.mode("append").parquet(dead_letters)
    return report(msgs)
