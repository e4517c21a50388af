"""Exact selection over hard distributions."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from synthloom.operators import metrics as M


def test_order_bits_order_like_doubles(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 / 3]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-320, 308) for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", M.order_bits(F.col("v")).alias("k")).collect()
    by_key = sorted(got, key=lambda r: r["k"])
    assert [r["v"] for r in by_key] == sorted(values)
    assert all((a["v"] == b["v"]) == (a["k"] == b["k"]) for a, b in zip(by_key, by_key[1:]))
    assert spark.createDataFrame([(math.nan,)], "v double").select(M.order_bits(F.col("v"))).first()[0] > max(r["k"] for r in got)


def test_selection_never_refuses(spark):
    """Equal values, one-bit clusters beside outliers, tiny groups, null keys and values."""
    rng = random.Random(2)
    groups = {"equal": [7.0] * 3000, "cluster": [1.0 + rng.randrange(50) * 2.0 ** -52 for _ in range(2000)] + [1e300, -1e300, 5e-324],
              "one": [3.25], "two": [-1.0, 4.0], None: [float(i % 17) for i in range(500)], "spread": [rng.gauss(0, 1e9) for _ in range(1500)]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in M.percentiles(df, "v", qs, ["g"]).collect()}
    want = {}
    for g, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        for q in qs:
            a = min(math.floor(n * q), n - 1)
            want[g, q] = (vs[a] + vs[(n - 1) // 2 if q == 0.5 else a]) / 2
    assert got == want
    assert M.percentiles(df.limit(0), "v", qs).count() == 0


def test_selection_scans_narrowly(spark):
    plan = M.percentiles(spark.range(1000).select("id", F.col("id").cast("double").alias("v")), "v", [0.5, 0.9])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 1000") == 1 and "Sort" not in plan
