"""Stateful sequences: per-user counters, wall-clock steps, expiry, arrival times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from synthloom.functions.times import SECOND, format_micros
from synthloom.session import keyed_position, lookup_join, run_positions

TTL_SECONDS = 86_400
COMPACT = 16  # micro-batches after which the state is written as a whole again


def shown(us: Column, fmt: str | None, tz: str | None) -> Column:
    return us if fmt is None else format_micros(us, fmt, tz)


def user_sequence(df: DataFrame, user: list[str], order: str, start: int, inc: int,
                  fmt: str | None = None, tz: str | None = None, name: str = "tick",
                  width: int = 65_536) -> DataFrame:
    """Per user: start+inc, start+2*inc, ... in order. The batch form of the keyed stream state."""
    placed = keyed_position(df, user, order, "_pos", width)
    us = F.lit(start) + (F.col("_pos") + 1) * F.lit(inc)
    return placed.withColumn(name, shown(us, fmt, tz)).drop("_pos")


def last_values(spark: SparkSession, path: str, epoch: int, user: list[str]) -> DataFrame | None:
    """State before micro-batch ``epoch``: one row (user..., last, seen) per user, newest first wins.

    The state is a log: every ``COMPACT`` micro-batches the whole of it, in between what each one changed.
    """
    if epoch == 0:
        return None
    base = (epoch - 1) // COMPACT * COMPACT
    parts = [spark.read.parquet(f"{path}/epoch={e}").withColumn("_e", F.lit(e)) for e in range(base, epoch)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*user).agg(F.max_by(F.struct("last", "seen"), "_e").alias("_s")).select(*user, "_s.last", "_s.seen")


def advance_sequence(batch: DataFrame, epoch: int, path: str, user: list[str], order: str, start: int, inc: int, name: str = "tick",
                     ts_us: str | None = None, ttl_seconds: int = TTL_SECONDS, drop_idle_seconds: int | None = None,
                     width: int = 65_536) -> None:
    """Number one micro-batch from the state before it; write its rows and the state after it.

    Both go to folders of their own, named by the micro-batch, so one that is replayed overwrites itself.
    """
    spark = batch.sparkSession
    state = last_values(spark, f"{path}/state", epoch, user)
    rows = batch.select(*user, order, *([ts_us] if ts_us else []))
    if state is None:
        rows = rows.withColumns({"last": F.lit(None).cast("bigint"), "seen": F.lit(None).cast("bigint")})
    else:
        rows = lookup_join(rows, state, user)
    if ts_us:
        rows = run_positions(rows, user, order, ts_us, ttl_seconds * SECOND, width, F.col("seen"))
        base = F.when(F.col("_run").isNull(), F.coalesce("last", F.lit(start))).otherwise(F.lit(start))
    else:
        rows = keyed_position(rows, user, order, "_pos", width)
        base = F.coalesce("last", F.lit(start))
    numbered = rows.withColumn(name, base + (F.col("_pos") + 1) * F.lit(inc))
    here = f"{path}/rows/epoch={epoch}"
    numbered.select(*user, order, *([ts_us, "seen"] if ts_us else ["seen"]), name).write.mode("overwrite").parquet(here)

    done = spark.read.parquet(here)
    known = F.when(F.col(ts_us).isNotNull(), F.col(order)) if ts_us else None
    changed = done.groupBy(*user).agg(
        F.max_by(name, order).alias("last"),
        (F.coalesce(F.max_by(ts_us, known), F.max("seen")) if ts_us else F.max("seen")).cast("bigint").alias("seen"))
    if epoch % COMPACT == 0 and state is not None:
        changed = changed.unionByName(state.join(changed.select(*user), user, "left_anti"))
        if drop_idle_seconds and ts_us:
            newest = changed.agg(F.max("seen")).scalar()
            changed = changed.where(F.col("seen").isNull() | (F.col("seen") >= newest - F.lit(drop_idle_seconds * SECOND)))
    changed.write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")


def user_sequence_stream(sdf: DataFrame, user: list[str], order: str, start: int, inc: int, path: str, checkpoint: str,
                         trigger: dict | None = None, **options) -> StreamingQuery:
    """Streaming form of ``user_sequence``: start a query that writes (user..., order, tick) below ``path``/rows.

    The last value of each user is kept in a table below ``path``/state and survives restarts. A micro-batch is
    numbered like a batch table, in slices of ``order``, so a user that holds most of its rows is spread over tasks;
    no Python runs on executors. With ``ts_us`` a pause above ``ttl_seconds`` restarts the user's sequence, also
    between micro-batches; a row without a time continues it. ``drop_idle_seconds`` forgets users that long behind the
    newest time whenever the state is compacted. Users may be null; ``order`` is a unique integer within the user.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        advance_sequence(batch, epoch, path, user, order, start, inc, **options)

    return sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sequence_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``user_sequence_stream`` has written."""
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("epoch", "seen")


def wallclock_sequence(df: DataFrame, time_us: Column, start: int, inc: int,
                       worker_start_us: int | None, user: list[str] | None = None, order: str | None = None,
                       fmt: str | None = None, tz: str | None = None, name: str = "tick") -> DataFrame:
    """Everybody sees start + whole increments elapsed since the worker started.

    Without a worker start the per-user sequence is used instead.
    """
    if worker_start_us is None:
        return user_sequence(df, user or [], order, start, inc, fmt, tz, name)
    steps = F.floor((time_us - F.lit(worker_start_us)) / F.lit(inc))
    return df.withColumn(name, shown(F.lit(start) + steps * F.lit(inc), fmt, tz))


def sequence_with_ttl(df: DataFrame, user: str, order: str, ts_us: str, start: int, inc: int,
                      ttl_seconds: int = TTL_SECONDS, name: str = "tick", width: int = 65_536) -> DataFrame:
    """Batch twin of expiring state: a gap above the time to live restarts the user's sequence.

    A row without a time continues it.
    """
    rows = run_positions(df, [user], order, ts_us, ttl_seconds * SECOND, width)
    return rows.withColumn(name, F.lit(start) + (F.col("_pos") + 1) * F.lit(inc)).drop("_run", "_pos")


def temporal_generator(df: DataFrame, mode: str, start: int, step: int = SECOND, multiplier: float = 1.0,
                       row: Column | None = None, time_us: Column | None = None,
                       started_us: int | None = None, name: str = "ts") -> DataFrame:
    """``per_generation``: start + (row+1)*step; ``actual_time_based``: start + elapsed*multiplier."""
    if mode == "per_generation":
        return df.withColumn(name, F.lit(start) + (row + 1) * F.lit(step))
    if mode == "actual_time_based":
        elapsed = (time_us - F.lit(started_us)) * F.lit(float(multiplier))
        return df.withColumn(name, F.lit(start) + elapsed.cast("bigint"))
    raise ValueError("mode must be per_generation or actual_time_based")


def arrival_segments(base_rate: int, bursts: list[tuple[float, float, int]]) -> list[tuple[int, int, int]]:
    """Pieces of constant rate ``(first_row, start_us, rate)`` from bursts ``(start_s, duration_s, rate)``."""
    pieces, row, now = [], 0, 0
    for begin_s, length_s, rate in sorted(bursts):
        begin, end = int(begin_s * SECOND), int((begin_s + length_s) * SECOND)
        if begin < now:
            raise ValueError("bursts overlap")
        for until, r in ((begin, base_rate), (end, rate)):
            if until > now:
                pieces.append((row, now, r))
                row, now = row + (until - now) * r // SECOND, until
    pieces.append((row, now, base_rate))
    return pieces


def arrival_shape(df: DataFrame, row: str, base_rate: int, bursts: list[tuple[float, float, int]] = (),
                  name: str = "arrival_us") -> DataFrame:
    """Arrival time of the n-th row at ``base_rate`` rows per second, faster inside bursts.

    The inverse of the cumulative rate is piecewise linear with one piece per burst edge.
    """
    if base_rate <= 0 or any(r <= 0 for _, _, r in bursts):
        raise ValueError("rates must be positive")
    out = None
    for first, start, rate in reversed(arrival_segments(base_rate, list(bursts))):
        since = F.col(row).cast("bigint") - F.lit(first)  # whole seconds and the rest, in integers throughout
        rest = F.call_function("div", (since % F.lit(rate)) * F.lit(SECOND), F.lit(rate).cast("bigint"))
        at = F.lit(start) + F.call_function("div", since, F.lit(rate).cast("bigint")) * F.lit(SECOND) + rest
        hit = F.col(row) >= first
        out = F.when(hit, at) if out is None else out.when(hit, at)
    return df.withColumn(name, out)
