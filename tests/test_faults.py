"""Faults: what was injected is what the detectors and the audit find."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from suite.specs import FLAT, READINGS
from synthloom.functions.draw import Draw
from synthloom.operators import audit, detect, faults as X, json_faults as J
from synthloom.plans.fault_plan import FaultOp, FaultPlan, apply_plan, draw_plan, register_fault
from synthloom.session import dense_position, keyed_position, lookup_join, top_per_key
from synthloom.sources.synth import synth_over

D = Draw(3)


@pytest.fixture(scope="module")
def clean(spark):
    rows = spark.range(4000).withColumnRenamed("id", "row_id")
    return synth_over(rows, FLAT, "row_id", 1, keep=["row_id"], now="2025-01-01").cache()


def count(df, op):
    return {r["op"]: r for r in audit.fault_audit(df).collect()}.get(op)


def test_null_field_matches_profile(clean):
    bad = X.null_field(clean, D, "row_id", fields=["tier", "amount"], p=0.2)
    nulls = {r["path"]: r["nulls"] for r in detect.null_profile(bad.select("tier", "amount")).collect()}
    hit = count(bad, "null_field")
    assert nulls["tier"] + nulls["amount"] == hit["rows"] and 0.15 < hit["share"] < 0.25


def test_one_cell_per_batch_and_none_without_candidates(clean, spark):
    bad = X.null_field(clean, D, "row_id", fields=["tier", "amount"], per="batch")
    assert bad.where("size(_faults) > 0").count() == 1
    empty = X.null_field(spark.createDataFrame([(1, None)], "row_id int, v string"), D, "row_id", fields=["v"], p=1.0)
    assert empty.first()["_faults"] == []


def test_duplicates_match_report(clean):
    bad = X.duplicate_rows(clean, D, "row_id", p=0.1)
    report = detect.duplicate_rows_report(bad.select(*clean.columns))
    assert report.agg(F.sum(F.col("copies") - 1)).first()[0] == count(bad, "duplicate_rows")["rows"]


def test_batch_duplicates_are_bounded_and_counted(clean):
    df = clean.withColumn("batch", F.when(F.col("row_id") < 3900, 0).otherwise(1)).withColumn(
        "size", F.when(F.col("batch") == 0, 3900).otherwise(100))
    bad = X.duplicate_rows_in_batch(df, D, "row_id", "batch", max_dups=3, count_col="size", strategy="random")
    got = {r["batch"]: (r["n"], r["s"]) for r in bad.groupBy("batch").agg(F.count("*").alias("n"), F.max("size").alias("s")).collect()}
    assert got == {0: (3903, 3903), 1: (103, 103)}


def test_nested_lists_duplicate_and_shuffle(spark):
    rows = spark.range(300).withColumnRenamed("id", "row_id")
    ev = synth_over(rows, READINGS, "row_id", 1, keep=["row_id"], now="2025-01-01").cache()
    dup = X.duplicate_elements(ev, D, "row_id", max_dups=1)
    grown = dup.select("row_id", F.size("samples").alias("n")).join(ev.select("row_id", F.size("samples").alias("m")), "row_id")
    assert grown.where("n <> m + 1").count() == 0
    spread = X.duplicate_elements(ev, D, "row_id", max_dups=2, strategy="random").select("row_id", F.size("samples").alias("n"))
    assert spread.join(ev.select("row_id", F.size("samples").alias("m")), "row_id").where("n <> m + least(m, 2)").count() == 0
    mixed = X.shuffle_arrays(ev, D, "row_id")
    a = mixed.select("row_id", F.sort_array(F.transform("samples", lambda x: F.to_json(x))).alias("a"))
    b = ev.select("row_id", F.sort_array(F.transform("samples", lambda x: F.to_json(x))).alias("b"))
    assert a.join(b, "row_id").where("a <> b").count() == 0
    assert mixed.join(ev.select("row_id", F.col("samples").alias("old")), "row_id").where("samples <> old").count() > 50


def test_count_sibling_follows_list(spark):
    df = spark.sql("select id as row_id, named_struct('count', 2, 'items', array(1, 2)) as box from range(5)")
    out = X.duplicate_elements(df, D, "row_id", max_dups=1).select("box.*").collect()
    assert all(r["count"] == 3 == len(r["items"]) for r in out)


def test_missing_is_not_null(clean):
    bad = X.partial_load(clean, D, "row_id", p=1.0, min_keys=1, max_keys=2, fields=["tier", "amount", "ok"])
    assert bad.where("size(_missing) not between 1 and 2").count() == 0
    for c in ("tier", "amount", "ok"):
        assert bad.where(F.array_contains("_missing", c) & F.col(c).isNotNull()).count() == 0
        assert bad.where(~F.array_contains("_missing", c) & F.col(c).isNull()).count() == 0


def test_nested_keys_can_go_missing(spark):
    df = spark.sql("select id as row_id, named_struct('a', 1, 'b', named_struct('c', 2)) as s from range(200)")
    bad = X.partial_load(df, D, "row_id", p=1.0, min_keys=1, max_keys=1)
    seen = {r[0] for r in bad.select(F.explode("_missing")).distinct().collect()}
    assert seen == {"s", "s.a", "s.b", "s.b.c"}
    assert bad.where("array_contains(_missing, 's.b.c') and (s.a is null or s.b.c is not null)").count() == 0


def test_truncation_is_detected(clean):
    bad = X.truncate_json(clean.select("row_id", "id", "amount"), D, "row_id", p=0.5)
    broken = bad.where("_corrupt_record is not null")
    report = detect.truncated_json_report(broken, "_corrupt_record").first()
    assert report["texts"] > 0 and report["unclosed"] == report["texts"] == report["invalid"]
    assert broken.where("id is not null or amount is not null").count() == 0
    assert bad.where("size(_fragments) > 0 and amount is not null").count() == 0


def test_bytes_are_cut_on_characters(spark):
    df = spark.createDataFrame([(i, "é" * 20) for i in range(200)], "row_id int, s string")
    bad = X.truncate_json(df, D, "row_id", p=1.0, nodes=["s"], unit="bytes")
    assert bad.where(~F.col("s").rlike('^"?é*$') | F.contains("s", F.lit("�"))).count() == 0


@pytest.mark.parametrize("strategy", ["insert", "repeat"])
def test_bloat_size(clean, strategy):
    bad = X.bloat(clean, D, "row_id", columns=["id"], p=0.3, extra_kb=2, strategy=strategy)
    grown = bad.where("size(_faults) > 0").select(F.length("id").alias("n"))
    low, high = grown.agg(F.min("n"), F.max("n")).first()
    assert (low, high) == (2058, 2058)


def test_corruption_is_seen_and_named(clean):
    bad = X.corrupt_text(clean, D, "row_id", columns=["id"], p=1.0)
    assert bad.where("id = concat('ORD-', lpad(substr(id, 5), 6, '0')) and size(_faults) = 0").count() == 0
    how = {r[0] for r in bad.select(F.regexp_extract(F.get("_faults", F.lit(0)), r" (\w+)\)", 1)).distinct().collect()}
    assert len(how) == 9
    classes = {r["class"]: r["rows"] for r in detect.encoding_report(bad, ["id"]).collect()}
    assert all(classes[c] > 0 for c in ("replacement", "zero_width", "fullwidth", "combining", "mixed_script"))
    changed = bad.join(clean.select("row_id", F.col("id").alias("old")), "row_id").where("id <> old").count()
    assert changed == clean.count()


def test_renamed_keys_and_columns(spark):
    df = spark.createDataFrame([(i, '{"abc": 1, "d": {"x": 2}}') for i in range(100)], "row_id int, doc string")
    bad = J.corrupt_key(df, D, "row_id", "doc", p=1.0)
    assert bad.where("try_parse_json(doc) is null").count() == 0
    assert bad.where("doc like '%\"abc\"%' and doc like '%\"d\"%' and doc like '%\"x\"%' and size(_faults) > 0").count() == 0
    renamed = X.corrupt_column_name(df.select("doc"), D)
    assert len(renamed.columns) == 1 and renamed.columns != ["doc"]


def test_skew_directions(clean):
    base = clean.select("row_id", "at", F.col("at").alias("old"))
    def deltas(**kw):
        return X.time_skew(base, D, "row_id", ["at"], max_skew_s=5, **kw).select((F.col("at") - F.col("old")).alias("d"))
    assert deltas(direction="future").where("d not between 0 and 5").count() == 0
    lo, hi = deltas(direction="both").agg(F.min("d"), F.max("d")).first()
    assert (lo, hi) == (-5, 5)
    assert deltas(unit="us", direction="future").where("d % 1000000 <> 0").count() == 0


def test_late_arrival_needs_elapsed_time(clean):
    quiet = X.late_arrival(clean, D, "row_id", "at", min_elapsed_seconds=10**9, p=1.0)
    assert quiet.where("size(_faults) > 0").count() == 0
    late = X.late_arrival(clean, D, "row_id", "at", late_window_seconds=60, p=1.0)
    top = clean.agg(F.max("at")).first()[0]
    assert late.where(~F.col("at").between(top - 60_000_000, top)).count() == 0


def test_time_columns_lenient(clean):
    strict = {r["column"]: r["encoding"] for r in X.time_columns(clean).collect()}
    assert strict == {"at": "epoch_micro", "tick": "epoch_micro", "day": "iso"}
    lenient = {r["column"] for r in X.time_columns(clean, "lenient").collect()}
    assert {"amount", "count", "ok", "at"} <= lenient


def test_plan_budget_forced_and_unknown(clean):
    plan = FaultPlan(ops=(FaultOp("null_field", 1.0, params={"fields": ["tier"]}), FaultOp("bloat", 1.0, params={"extra_kb": 0}),
                          FaultOp("nope", 1.0)), min_ops=3, max_ops=3, max_faults=1)
    df = draw_plan(clean, plan, D, "row_id")
    assert {r[0] for r in df.select(F.size("_plan")).distinct().collect()} == {1}
    forced = apply_plan(clean, FaultPlan(ops=plan.ops, forced=("null_field", "ghost")), D, "row_id")
    assert forced.where("tier is not null").count() == 0
    assert draw_plan(clean, FaultPlan(ops=plan.ops, max_ops=0), D, "row_id").where("size(_plan) > 0").count() == 0
    assert draw_plan(clean, FaultPlan(ops=(FaultOp("bloat", 1.0, enabled=False),)), D, "row_id").where("size(_plan) > 0").count() == 0


def test_plan_per_batch_is_uniform_inside(clean):
    df = clean.withColumn("batch", F.floor(F.col("row_id") / 100))
    plan = FaultPlan(ops=(FaultOp("null_field", 0.5, params={"fields": ["tier"]}),), min_ops=1, max_ops=1)
    bad = apply_plan(df, plan, D, "row_id", scope="batch")
    per = bad.groupBy("batch").agg(F.count_if(F.col("tier").isNull()).alias("n")).select("n").distinct()
    assert {r[0] for r in per.collect()} == {0, 100}


def test_custom_fault(clean):
    register_fault("upper", lambda df, draw, key, hit=None, **kw: df.withColumn("id", F.when(hit, "UP").otherwise(F.col("id"))))
    plan = FaultPlan(ops=(FaultOp("upper", 0.5),), min_ops=1, max_ops=1)
    assert 1500 < apply_plan(clean, plan, D, "row_id").where("id = 'UP'").count() < 2500


def test_partitioning_does_not_change_damage(clean):
    def damaged(df):
        plan = FaultPlan(ops=(FaultOp("null_field", 0.5), FaultOp("corrupt_text", 0.5), FaultOp("duplicate_rows", 0.3)), max_ops=3)
        return sorted(map(str, apply_plan(df, plan, D, "row_id").collect()))
    assert damaged(clean) == damaged(clean.repartition(13)) == damaged(clean.coalesce(1))


def test_positions_under_a_hot_key(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 != 0, 0).otherwise(F.col("id") % 7).alias("k"))
    placed = keyed_position(rows, ["k"], "id", "n", width=500)
    per = placed.groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.countDistinct("n").alias("d"))
    assert per.where("m + 1 <> c or d <> c").count() == 0
    dense = dense_position(rows, [F.col("k").desc(), F.col("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in dense] == list(range(30_000))
    assert [(r["k"], r["id"]) for r in dense] == sorted(((r["k"], r["id"]) for r in dense), key=lambda x: (-x[0], x[1]))
    top = top_per_key(rows, ["k"], [F.col("id").desc()], 4, salts=8)
    newest: dict[int, list[int]] = {}
    for i in range(29_999, -1, -1):
        newest.setdefault(0 if i % 3 else i % 7, []).append(i)
    assert sorted((r["k"], r["id"]) for r in top.collect()) == sorted((k, i) for k, v in newest.items() for i in v[:4])


def test_lookup_join_under_hot_and_null_keys(spark):
    rows = spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 500).alias("k"))
    lookup = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup_join(rows, lookup, ["k"])
    want = rows.join(lookup, "k", "left")
    assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))
