"""Stores that change over commits, and takers that compete."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from synthloom.session import work_dir
from synthloom.sources.storelog import ClaimLedger, StoreLog, Versions, sync_logs

DDL = "id string, v int"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def state(log):
    return {r["id"]: r["v"] for r in log.read().collect()}


def test_commits_read_back(spark):
    log = StoreLog(spark, work_dir(spark, "log"), DDL)
    assert state(log) == {}
    assert log.commit(put=table(spark, ("a", 1), ("b", 2), ("c", None)), retry_key="one")
    assert not log.commit(put=table(spark, ("a", 9)), retry_key="one") and state(log) == {"a": 1, "b": 2, "c": None}
    log.commit(put=table(spark, ("b", 3), ("d", 4)), delete=table(spark, ("a", 0), ("d", 0), ("zz", 0)))
    assert state(log) == {"b": 3, "c": None, "d": 4}
    log.compact()
    assert state(log) == {"b": 3, "c": None, "d": 4} and len(log.versions.latest()[1]["segments"]) == 1
    assert not log.commit(delete=table(spark, ("b", 0)), retry_key="one")
    log.commit(delete=table(spark, ("b", 0)))
    log.commit(put=table(spark, ("b", 7)))
    assert state(log) == {"b": 7, "c": None, "d": 4}
    log.commit(delete=log.read())
    log.compact()
    assert state(log) == {}
    plan = log.read().where("id = 'b'")._jdf.queryExecution().executedPlan().toString()
    log.commit(put=table(spark, ("b", 7)))
    plan = log.read().where("id = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(id,b)") == 2  # both segments


def test_two_writers_of_one_version(spark):
    versions = Versions(spark, work_dir(spark, "versions"))
    assert versions.latest() == (0, None)
    assert versions.publish(1, {"n": 1}) and not versions.publish(1, {"n": 2})
    assert versions.latest() == (1, {"n": 1})
    with ThreadPoolExecutor(4) as pool:  # each adds one, on top of the others
        list(pool.map(lambda _: versions.change(lambda d: ({"n": d["n"] + 1}, None)), range(6)))
    assert versions.latest() == (7, {"n": 7})


def test_sync_is_repeatable_and_never_loses(spark):
    folder = work_dir(spark, "sync")
    hot, durable = StoreLog(spark, folder + "/hot", DDL), StoreLog(spark, folder + "/durable", DDL)
    hot.commit(put=table(spark, ("a", 1), ("b", 2)))
    durable.commit(put=table(spark, ("b", 5)))
    move = lambda h, d: (d.unionByName(h.join(d, "id", "left_anti")), h.limit(0), None)
    # a run that stopped after its first commit
    durable.commit(put=table(spark, ("a", 1)), retry_key="k")
    assert sync_logs(hot, durable, move, "k") and not sync_logs(hot, durable, move, "k")
    assert state(durable) == {"a": 1, "b": 5} and state(hot) == {}


def test_takers_never_share(spark):
    ready = spark.range(40).select(F.lit("s").alias("schema"), F.col("id").alias("row_id"))
    live = spark.range(100, 140).select(F.lit("s").alias("schema"), F.col("id").alias("row_id"))
    ledger = ClaimLedger(spark, work_dir(spark, "claims"))
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda _: [r["row_id"] for r in ledger.take(ready, live, "s", 8).collect()], range(4)))
    assert sorted(x for part in found for x in part) == list(range(32))
    assert [r["row_id"] for r in ledger.take(ready, live, "s", 20, retry_key="k").collect()] == list(range(32, 40))
    assert [r["row_id"] for r in ledger.take(ready, live, "s", 20, retry_key="k").collect()] == list(range(32, 40))
    assert [r["row_id"] for r in ledger.take(ready, live, "s", 3).collect()] == [100, 101, 102]
    with pytest.raises(LookupError):
        ledger.take(ready, live, "s", 3, require=True)
    assert ledger.take(ready.limit(0), live, "other", 3).count() == 0
