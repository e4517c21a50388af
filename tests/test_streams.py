"""Streams equal their batch twins, survive restarts and keep state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from suite.specs import FLAT
from synthloom.functions.draw import Draw
from synthloom.operators import faults as X
from synthloom.session import work_dir
from synthloom.sources import pregen, publish as P
from synthloom.sources.synth import synth, synth_stream
from synthloom.streaming import flows as ST, sequences as SQ

DAY_US = 86_400_000_000


def feed(spark, folder, rows, schema):
    """Add one file to a stream's input folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(sdf, folder, mode="append"):
    (sdf.writeStream.outputMode(mode).format("parquet").option("path", folder + "/out")
     .option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination(120))


def sequence(sdf, folder, start, **options):
    SQ.user_sequence_stream(sdf, ["user"], "n", start, 10, folder, folder + "/checkpoint", **options).awaitTermination(120)


def test_synth_stream_equals_table_and_resumes(spark):
    folder = work_dir(spark, "synth")
    sdf = synth_stream(spark, FLAT, 50, seed=4, max_rows=120, now="2025-01-01")
    for _ in range(2):
        q = sdf.writeStream.format("parquet").option("path", folder + "/out").option(
            "checkpointLocation", folder + "/state").trigger(processingTime="0 seconds").start()
        for _ in range(150):
            if q.lastProgress and q.lastProgress["batchId"] >= 2:
                break
            q.awaitTermination(0.2)
        q.stop()
    got = spark.read.schema(sdf.schema).parquet(folder + "/out").orderBy("seq").drop("seq").collect()
    want = synth(spark, FLAT, 120, seed=4, now="2025-01-01").collect()
    assert got == want[:len(got)] and len(got) >= 100


def test_user_sequence_continues_over_restarts(spark):
    folder, schema = work_dir(spark, "seq"), "user int, n bigint"
    for start in (0, 3, 6):
        feed(spark, folder + "/in", [(u, start + i) for u in (1, 2) for i in range(3)], schema)
        sdf = spark.readStream.schema(schema).parquet(folder + "/in")
        sequence(sdf, folder, 1_000_000)
    rows = SQ.sequence_rows(spark, folder).orderBy("user", "n").collect()
    assert [r["tick"] for r in rows if r["user"] == 1] == [1_000_000 + 10 * (i + 1) for i in range(9)]


def test_expired_state_restarts_like_the_batch_twin(spark):
    folder, schema = work_dir(spark, "ttl"), "user int, n bigint, us bigint"
    rows = [(1, i, i * 60_000_000 + (2 * DAY_US if i >= 4 else 0) + (5 * DAY_US if i >= 7 else 0)) for i in range(9)]
    for part in (rows[:3], rows[3:6], rows[6:]):
        feed(spark, folder + "/in", part, schema)
        sdf = spark.readStream.schema(schema).parquet(folder + "/in")
        sequence(sdf, folder, 0, ts_us="us")
    streamed = [r["tick"] for r in SQ.sequence_rows(spark, folder).orderBy("n").collect()]
    twin = SQ.sequence_with_ttl(spark.createDataFrame(rows, schema), "user", "n", "us", 0, 10, width=2).orderBy("n")
    assert streamed == [r["tick"] for r in twin.collect()] == [10, 20, 30, 40, 10, 20, 30, 10, 20]


def test_dedup_across_batches(spark):
    folder, schema = work_dir(spark, "dedup"), "id bigint, at timestamp"
    for _ in range(2):
        (spark.range(20).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"))
         .coalesce(1).write.mode("append").parquet(folder + "/in"))
        run(ST.stream_dedup(spark.readStream.schema(schema).parquet(folder + "/in"), ["id"], "at", "1 hour"), folder)
    assert spark.read.parquet(folder + "/out").count() == 20


def test_windows_sliding_and_session(spark):
    folder, schema = work_dir(spark, "win"), "at timestamp, k int"
    (spark.range(10_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("at"), (F.col("id") % 2).cast("int").alias("k"))
     .coalesce(1).write.parquet(folder + "/in"))
    sdf = spark.readStream.schema(schema).parquet(folder + "/in")
    run(ST.late_filter(sdf, "at", "1 hour", "1 day", ["k"], slide="12 hours"), folder)
    full = spark.read.parquet(folder + "/out").where("rows = 720")
    assert full.count() >= 4
    other = work_dir(spark, "ses")
    run(ST.late_filter(sdf.where("at > '2023-11-15' and minute(at) < 30"), "at", "1 hour", "", ["k"], session_gap="10 minutes"), other)
    assert spark.read.parquet(other + "/out").where("rows <> 15").count() <= 2


@pytest.mark.parametrize("rate,seconds,rows", [(5000, 5, 25_000), (8000, 15, 120_000)])
def test_burst_rows(rate, seconds, rows):
    pieces = SQ.arrival_segments(100, [(0, seconds, rate)])
    assert pieces == [(0, 0, rate), (rows, seconds * 1_000_000, 100)]


def test_overlapping_bursts_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        SQ.arrival_segments(10, [(0, 10, 100), (5, 10, 100)])


def test_wallclock_falls_back_to_sequence(spark):
    df = spark.createDataFrame([(1, i) for i in range(4)], "user int, n bigint")
    out = SQ.wallclock_sequence(df, F.lit(0), 100, 10, None, ["user"], "n").orderBy("n").collect()
    assert [r["tick"] for r in out] == [110, 120, 130, 140]


def test_require_prepared_rows(spark):
    live = spark.range(5)
    with pytest.raises(Exception, match="no prepared rows"):
        pregen.pregen_or_live(spark.range(0), live, 3, "id", require=True).collect()
    assert pregen.pregen_or_live(spark.range(2), live, 3, "id", require=True).count() == 2


def test_pregen_caps(spark):
    path = work_dir(spark, "caps")
    df = spark.range(100).select((F.col("id") % 2).alias("s"), F.floor(F.col("id") / 2).alias("n"), F.col("id").alias("g"))
    pregen.pregen_write(df, path, "s", "n", 30, global_max_items=50, global_row="g")
    assert spark.read.parquet(path).groupBy("s").count().orderBy("s").collect() == [(0, 25), (1, 25)]


def test_publish_reports_failures_and_loses_nothing(spark):
    df = spark.range(10).select("id", F.when(F.col("id") == 3, F.repeat(F.lit("x"), 2_000_000)).when(F.col("id") > 4, "y").alias("v"))
    path, dead = work_dir(spark, "pub"), work_dir(spark, "dead")
    report = P.publish(df, "t", "id", 4, "json", path, max_bytes=1_048_576, dead_letters=dead).first()
    assert (report["sent"], report["failed"], report["batches"]) == (9, 1, 3)
    assert spark.read.json(path).count() == 9 and spark.read.parquet(dead).count() == 1
    whole = work_dir(spark, "pub")
    assert P.publish(df, "t", "id", 20_000, "json", whole).first()["failed"] == 0
    got = [r["value"] for r in spark.read.json(whole).collect()]
    assert len(got) == 10 and '{"id":0,"v":null}' in got  # a null is not a missing key
    with pytest.raises(ValueError, match="dead_letters"):
        P.publish(df, "t", "id", 4, "json", path, max_bytes=100)


def test_appends_of_one_seed_stay_apart(spark):
    import datetime as dt

    from synthloom.operators import store
    from synthloom.sources import datasets as DS

    def append(first: int, minute: int):
        rows = spark.range(3).select(F.lit("s").alias("schema"), F.col("id").alias("seq"),
                                     F.when(F.col("id") > 0, F.col("id") + first).alias("v"))
        return DS.dataset_append(rows, DS.DatasetMeta(7, dt.datetime(2024, 1, 1, 0, minute)), "schema", "seq")

    one, two = append(0, 0), append(3, 1)
    assert one.first()["id"] == append(0, 0).first()["id"] != two.first()["id"]
    assert store.find_missing(one.union(two), one).count() == 1
    assert one.first()["data"].startswith('{"items":[{"v":null},')


def test_bloat_knows_every_named_column_and_its_length(spark):
    names = [f"c{i}" for i in range(12)]
    df = spark.range(400).select("id", *[F.lit("hello").alias(c) for c in names])
    grown = X.bloat(df, Draw(1, kind="portable"), "id", columns=names, p=1.0, extra_kb=32, strategy="repeat")
    sizes = grown.select(*[(F.length(c) - 5).alias(c) for c in names])
    long = {c for r in sizes.collect() for c in names if r[c]}
    assert long == set(names) and {v for r in sizes.collect() for v in r if v} == {32 * 1024}


def test_micro_batch_faults_can_be_replayed(spark):
    folder = work_dir(spark, "each")
    spark.range(50).coalesce(1).write.parquet(folder + "/in")
    sdf = spark.readStream.schema("id bigint").parquet(folder + "/in")
    damage = lambda df, epoch: X.shuffle_rows(df, Draw(1), "id")
    ST.each_batch(sdf, damage, folder + "/out", folder + "/s1").awaitTermination(60)
    ST.each_batch(sdf, damage, folder + "/out", folder + "/s2").awaitTermination(60)
    assert spark.read.parquet(folder + "/out").select("ord").distinct().count() == 50 == spark.read.parquet(folder + "/out").count()


def test_user_sequence_spreads_a_hot_user_and_takes_odd_rows(spark, monkeypatch):
    """Mixed order, rows without a time, a null user, state over compactions and a replayed micro-batch."""
    monkeypatch.setattr(SQ, "COMPACT", 3)
    folder, schema = work_dir(spark, "order"), "user int, n bigint, us bigint"
    rows = [(1, i, None if i % 7 == 3 else i * 60_000_000 + (2 * DAY_US if i >= 300 else 0)) for i in range(450)]
    rows += [(None, i, i * DAY_US) for i in range(5)] + [(2, i, None) for i in range(9)]
    want = {}
    for user in (1, None, 2):
        last, seen = 0, None
        for _, n, us in sorted(r for r in rows if r[0] == user) if user else [r for r in rows if r[0] is None]:
            last = 0 if us is not None and seen is not None and us - seen > DAY_US else last
            last, seen = last + 10, us if us is not None else seen
            want[user, n] = last
    for k in range(8):
        part = [r for r in rows if r[1] * 8 // (450 if r[0] == 1 else 9) == k]
        batch = spark.createDataFrame(part[::-1][::2] + part[::-1][1::2], schema)
        for _ in range(1 + (k in (3, 4))):  # a replay gives the same again
            SQ.advance_sequence(batch, k, folder, ["user"], "n", 0, 10, ts_us="us", width=16)
    got = {(r["user"], r["n"]): r["tick"] for r in SQ.sequence_rows(spark, folder).collect()}
    assert got == want
    state = {r["user"]: r["last"] for r in SQ.last_values(spark, folder + "/state", 8, ["user"]).collect()}
    assert state[1] == want[1, 449] and state[2] == want[2, 8]
    plan = SQ.sequence_with_ttl(spark.createDataFrame(rows, schema), "user", "n", "us", 0, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 15 and "Python" not in plan
