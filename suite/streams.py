"""Streaming operators and their batch twins, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import faults as FS
from suite.common import SEED, Suite, digest, table
from suite.tables import run_stream, stream_table
from synthloom.functions.draw import Draw
from synthloom.operators import faults as X
from synthloom.plans.fault_plan import FaultOp, FaultPlan
from synthloom.session import work_dir
from synthloom.streaming import flows as ST, sequences as SQ

suite = Suite()
D = Draw(SEED, kind="portable")
E = "event_id"
START, INC = 1_000_000, 10


def ts_us():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def events(spark, sf):
    return table(spark, sf, "events").withColumn("us", ts_us())


_POS = "row_number() OVER (PARTITION BY user_id ORDER BY event_id)"


@suite.add("st1_user_sequence", f"""
SELECT user_id, event_id, {START}+{_POS}*{INC} AS tick, strftime(make_timestamp(1704067200000000+{_POS}*60000000+7200000000), '%Y-%m-%dT%H:%M:%S')||'+0200' AS shown
FROM events""")
def user_sequence(spark, sf):
    df = SQ.user_sequence(table(spark, sf, "events").select("user_id", E), ["user_id"], E, START, INC, width=1_000)
    shown = SQ.user_sequence(table(spark, sf, "events").select("user_id", E), ["user_id"], E, 1704067200000000, 60_000_000,
                             "%Y-%m-%dT%H:%M:%S%z", "+02:00", name="shown")
    return df.join(shown, ["user_id", E])


def streamed(spark, sf, **options):
    """The stream's rows; files of the table arrive in one or more micro-batches."""
    folder = work_dir(spark, "sequence")
    sdf = stream_table(spark, sf, "events").select("user_id", E, ts_us().alias("us"))
    SQ.user_sequence_stream(sdf, ["user_id"], E, START, INC, folder, folder + "/checkpoint", **options).awaitTermination()
    return SQ.sequence_rows(spark, folder)


@suite.add("st1_user_sequence_stream", f"SELECT user_id, {START}+{_POS}*{INC} AS tick FROM events")
def user_sequence_stream(spark, sf):
    return streamed(spark, sf).select("user_id", "tick")


@suite.add("st1_user_sequence_stream_events", f"SELECT user_id, event_id, {START}+{_POS}*{INC} AS tick FROM events")
def user_sequence_stream_events(spark, sf):
    return streamed(spark, sf).select("user_id", E, "tick")


@suite.add("st1_user_sequence_stream_ttl", f"""
WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) > 6*3600000000 AS fresh FROM events),
r AS (SELECT *, count_if(coalesce(fresh, false)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g)
SELECT user_id, event_id, {START}+row_number() OVER (PARTITION BY user_id, run ORDER BY event_id)*{INC} AS tick FROM r""")
def user_sequence_stream_ttl(spark, sf):
    return streamed(spark, sf, ts_us="us", ttl_seconds=6 * 3600, width=500).select("user_id", E, "tick")


@suite.add("st2_wallclock_sequence", """
SELECT event_id, 500+(epoch_us(ts)-1704067200000000)//60000000*60000000 AS tick FROM events""")
def wallclock_sequence(spark, sf):
    return SQ.wallclock_sequence(events(spark, sf), F.col("us"), 500, 60_000_000, 1704067200000000).select(E, "tick")


@suite.add("st3_state_ttl", f"""
WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
i AS (SELECT *, count(*) FILTER (p IS NULL OR us-p > 86400000000) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM g)
SELECT user_id, event_id, {START}+row_number() OVER (PARTITION BY user_id, island ORDER BY event_id)*{INC} AS tick FROM i""")
def state_ttl(spark, sf):
    df = SQ.sequence_with_ttl(events(spark, sf).select("user_id", E, "us"), "user_id", E, "us", START, INC, width=1_000)
    return df.select("user_id", E, "tick")


@suite.add("st4_temporal_generator", """
SELECT event_id, 1704067200000000+(event_id+1)*250000 AS gen, 1704067200000000+trunc((epoch_us(ts)-1704067200000000)*1.5::DOUBLE)::BIGINT AS actual FROM events""")
def temporal_generator(spark, sf):
    df = SQ.temporal_generator(events(spark, sf), "per_generation", 1704067200000000, 250_000, row=F.col(E), name="gen")
    df = SQ.temporal_generator(df, "actual_time_based", 1704067200000000, multiplier=1.5, time_us=F.col("us"),
                               started_us=1704067200000000, name="actual")
    return df.select(E, "gen", "actual")


@suite.add("st5_stream_faults", f"""
WITH o AS (SELECT *, {FS.offer(['event_type', 'value'], 'null_field', E)}.f AS f FROM events)
SELECT event_id, CASE WHEN f <> 'event_type' THEN event_type END AS event_type, CASE WHEN f <> 'value' THEN value END AS value,
 'null_field('||f||')' AS faults FROM o""")
def stream_faults(spark, sf):
    plan = FaultPlan(ops=(FaultOp("null_field", params={"fields": ["event_type", "value"]}),), forced=("null_field", "not_an_operator"))
    out = ST.stream_faults(stream_table(spark, sf, "events"), plan, D, E)
    return run_stream(out.select(E, "event_type", "value", F.array_join("_faults", ";").alias("faults")), "faults")


@suite.add("st5_stream_batch_faults", f"""
SELECT event_id, row_number() OVER (ORDER BY {digest('shuffle_rows', E)})-1 AS ord FROM events""")
def stream_batch_faults(spark, sf):
    path = work_dir(spark, "batches")
    ST.each_batch(stream_table(spark, sf, "events").select(E), lambda df, epoch: X.shuffle_rows(df, D, E).select(E, "ord"),
                  path + "/data", path + "/state").awaitTermination()
    return spark.read.parquet(path + "/data").select(E, "ord")


@suite.add("st6_late_filter", f"""
WITH bad AS ({FS.suite.sql['f13_late_arrival']}),
w AS (SELECT us, coalesce(us < max(us) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)-3600000000, false) AS late FROM bad),
x AS (SELECT us//43200000000*43200000000 AS last, late FROM w)
SELECT unnest([last-43200000000, last]) AS start_us, late::INT AS l FROM x""".join(["SELECT start_us, count(*) FILTER (l = 0) AS on_time, count(*) FILTER (l = 1) AS late FROM (", ") GROUP BY 1"]))
def late_filter(spark, sf):
    df = X.late_arrival(table(spark, sf, "events"), D, E, "ts", late_window_seconds=7200, p=0.1).withColumn("us", ts_us())
    marked = ST.split_late(df.select(E, "us"), "us", E, 3_600_000_000, width=1_000)
    return ST.window_counts(marked, "us", 86_400_000_000, 43_200_000_000)


@suite.add("st6_late_filter_stream", """
SELECT epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS rows FROM events GROUP BY 1
HAVING epoch_us(date_trunc('day', ts))+86400000000 <= (SELECT max(epoch_us(ts)) FROM events)-3600000000""")
def late_filter_stream(spark, sf):
    sdf = stream_table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = ST.late_filter(sdf, "at", "1 hour", "1 day")
    return run_stream(out.select(F.unix_micros("start").alias("start_us"), "rows"), "windows")


@suite.add("st6_session_counts", """
WITH g AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
i AS (SELECT *, count(*) FILTER (p IS NULL OR us-p > 3600000000) OVER (PARTITION BY user_id ORDER BY us) AS s FROM g)
SELECT user_id, min(us) AS start_us, max(us)+3600000000 AS end_us, count(*) AS rows FROM i GROUP BY user_id, s""")
def session_counts(spark, sf):
    return ST.session_counts(events(spark, sf), "us", 3600, ["user_id"])


@suite.add("st7_arrival_shape", """
SELECT event_id, CASE WHEN event_id < 1000 THEN event_id*1000000//100 WHEN event_id < 6000 THEN 10000000+(event_id-1000)*1000000//1000
 WHEN event_id < 6500 THEN 15000000+(event_id-6000)*1000000//100 WHEN event_id < 7500 THEN 20000000+(event_id-6500)*1000000//2000
 ELSE 20500000+(event_id-7500)*1000000//100 END AS arrival_us FROM events""")
def arrival_shape(spark, sf):
    df = table(spark, sf, "events").select(E)
    return SQ.arrival_shape(df, E, 100, [(20, 0.5, 2000), (10, 5, 1000)])


@suite.add("st8_stream_dedup", "SELECT event_id, user_id, value FROM events")
def stream_dedup(spark, sf):
    doubled = X.duplicate_rows(table(spark, sf, "events"), D, E, p=0.3, max_dups=2)
    return ST.batch_dedup(doubled.select(E, "user_id", "value", "_copy"), [E], "_copy").select(E, "user_id", "value")


@suite.add("st8_stream_dedup_stream", "SELECT event_id, user_id, value FROM events")
def stream_dedup_stream(spark, sf):
    doubled = X.duplicate_rows(stream_table(spark, sf, "events"), D, E, p=0.3, max_dups=2)
    sdf = doubled.withColumn("at", F.col("ts").cast("timestamp")).select(E, "user_id", "value", "at")
    return run_stream(ST.stream_dedup(sdf, [E], "at", "1 hour"), "dedup").select(E, "user_id", "value")


@suite.add("st9_resume", "SELECT event_id, value FROM events")
def resume(spark, sf):
    path = work_dir(spark, "resume")
    for _ in range(2):  # the second run finds nothing new: no row is lost or sent twice
        ST.resume(stream_table(spark, sf, "events").select(E, "value"), path + "/data", path + "/state").awaitTermination()
    return spark.read.parquet(path + "/data")
