"""Time texts and time-zone free timestamps do not depend on the session's time zone."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from synthloom.functions.draw import Draw
from synthloom.functions.times import clock_to_micros, format_micros, micros_to_clock, text_to_micros
from synthloom.operators import faults
from synthloom.sources.synth import synth

EPOCH = dt.datetime(1970, 1, 1)
# around changes to and from summer time in both zones, before 1970, and plain days
MOMENTS = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2024, 3, 31, 2, 30, 1, 5), dt.datetime(2024, 1, 1),
           dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(2024, 12, 31, 12, 0), dt.datetime(1900, 2, 28, 0, 5)]
FORMAT = "%Y-%m-%dT%H:%M:%S.%f|%y %j %b %B %a %A %I %p 100%%"


@pytest.fixture(params=["UTC", "America/New_York", "Europe/Berlin"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_formats_and_clocks(spark, zone):
    us = [(m - EPOCH) // dt.timedelta(microseconds=1) for m in MOMENTS]
    df = spark.createDataFrame([(u,) for u in us], "us long")
    got = df.select("us", format_micros(F.col("us"), FORMAT).alias("t"), format_micros(F.col("us"), "%H:%M%z", "+05:30").alias("z"),
                    micros_to_clock(F.col("us")).alias("c"), clock_to_micros(micros_to_clock(F.col("us"))).alias("back")).collect()
    for m, r in zip(MOMENTS, got):
        assert r["t"] == m.strftime(FORMAT.replace("%Y", f"{m.year:04d}")) and r["c"] == m and r["back"] == r["us"]
        assert r["z"] == (m + dt.timedelta(hours=5, minutes=30)).strftime("%H:%M+0530")


def test_texts(spark, zone):
    cases = {"2024-03-10T02:30:00": dt.datetime(2024, 3, 10, 2, 30), "2024-03-10 02:30:00.5": dt.datetime(2024, 3, 10, 2, 30, 0, 500_000),
             "2024-03-10T02:30:00Z": dt.datetime(2024, 3, 10, 2, 30), "2024-03-10T02:30:00+02:00": dt.datetime(2024, 3, 10, 0, 30),
             "20240310": dt.datetime(2024, 3, 10), "2024-03-10": dt.datetime(2024, 3, 10), "no time": None, "20249999": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", text_to_micros(F.col("t")).alias("us")).collect():
        want = cases[r["t"]]
        assert r["us"] == (None if want is None else (want - EPOCH) // dt.timedelta(microseconds=1)), r["t"]


def test_generated_and_skewed_times(spark, zone):
    spec = {"type": "object", "fields": {
        "moment": {"type": "timestamp", "start": "2024-03-10T02:00:00+00:00", "end": "2024-03-10T03:00:00+00:00"},
        "at": {"type": "datetime", "start": "2024-03-10T02:00:00+00:00", "end": "2024-03-10T03:00:00+00:00"},
        "day": {"type": "datetime", "format": "%Y%m%d", "depends_on": "moment"}}}
    made = synth(spark, spec, 50, now="2025-01-01").collect()
    assert all(r["at"].startswith("2024-03-10T02:") and r["day"] == "20240310" for r in made)
    df = spark.sql("select 1 id, '2024-03-10T02:30:00' a, timestamp_ntz'2024-03-10 02:30:00' b, '2024-03-10T02:30:00Z' c")
    row = faults.time_skew_typed(df, Draw(1), "id", ["a", "b", "c"], max_skew_s=1).first()  # whole seconds below one: none
    assert (row["a"], row["b"], row["c"]) == ("2024-03-10T02:30:00", dt.datetime(2024, 3, 10, 2, 30), "2024-03-10T02:30:00Z")
