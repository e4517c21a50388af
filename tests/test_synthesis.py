"""Specs: ranges, shares, determinism, contracts."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite.specs import EVERY_NODE, READINGS, SHIPMENTS
from synthloom.operators import detect, link
from synthloom.plans import spec as S
from synthloom.sources.synth import Engine, synth, synth_over

NOW = "2025-06-15T10:30:00+00:00"
N = 20_000


def obj(**fields):
    return {"type": "object", "fields": fields}


def share(df, cond):
    row = df.agg(F.avg(cond.cast("double")).alias("s"), F.count("*").alias("n")).first()
    return row["s"], row["n"]


def near(df, cond, p):
    seen, n = share(df, cond)
    assert abs(seen - p) <= 4 * math.sqrt(max(p * (1 - p), 1e-4) / n)


@pytest.mark.parametrize("kind", ["fast", "portable"])
def test_scalar_laws(spark, kind):
    spec = obj(num={"type": "int", "min": 1, "max": 5}, step={"type": "int", "min": 0, "max": 10, "step": 5},
               flag="bool", bias={"type": "enum", "values": ["x", "y"], "weights": [1, 100]},
               prec={"type": "float", "min": 0, "max": 1, "precision": 3},
               none={"type": "maybe", "p_null": 1, "child": {"type": "string", "template": "X"}},
               never={"type": "maybe", "p_null": 0, "child": {"type": "string", "template": "X"}},
               arr={"type": "array", "min_items": 1, "max_items": 3, "child": "bool"},
               rx={"type": "string", "regex": "^[a-z0-9]{8}$"})
    df = synth(spark, spec, N, seed=123, kind=kind).cache()
    assert {r[0] for r in df.select("num").distinct().collect()} == {1, 2, 3, 4, 5}
    assert {r[0] for r in df.select("step").distinct().collect()} == {0, 5, 10}
    near(df, F.col("flag"), 0.5)
    near(df, F.col("bias") == "y", 100 / 101)
    assert df.where(F.abs(F.col("prec") * 1000 - F.rint(F.col("prec") * 1000)) > 1e-6).count() == 0
    assert df.where("none is not null or never is null").count() == 0
    assert {r[0] for r in df.select(F.size("arr")).distinct().collect()} == {1, 2, 3}
    assert df.where(~F.col("rx").rlike("^[a-z0-9]{8}$")).count() == 0


def test_select_modes(spark):
    def sel(**pick):
        return {"type": "select", "pick": pick, "options": {
            "req": {"of": "int", "required": True}, "a": {"of": "int"}, "b": {"of": "int"}, "c": {"of": "int"}}}

    df = synth(spark, obj(exact=sel(mode="exact", min=1), rng=sel(mode="range", min=1, max=2),
                          least=sel(mode="at_least_one"), free=sel(),
                          heavy=sel(mode="exact", min=1, weights={"a": 8, "b": 1, "c": 1}),
                          zero=sel(mode="exact", min=2, weights={"a": 0})), N, seed=1).cache()
    def picked(c):
        return sum(F.col(f"{c}.{k}").isNotNull().cast("int") for k in "abc")
    for name, allowed in {"exact": {1}, "rng": {1, 2}, "least": {1, 2, 3}, "free": {0, 1, 2, 3}}.items():
        assert {r[0] for r in df.select(picked(name)).distinct().collect()} == allowed
    assert df.where("exact.req is null").count() == 0
    near(df, F.col("heavy.a").isNotNull(), 0.8)
    assert df.where("zero.a is not null").count() == 0


def test_same_seed_same_rows_any_partitioning(spark):
    def rows(**kw):
        return [r.asDict(True) for r in synth(spark, READINGS, 300, seed=5, now=NOW, **kw).orderBy("reading").collect()]

    one = rows(partitions=1)
    assert one == rows(partitions=3) == rows(partitions=16)
    assert one != [r.asDict(True) for r in synth(spark, READINGS, 300, seed=6, now=NOW).orderBy("reading").collect()]


def test_slices_join_to_the_whole(spark):
    spec = obj(a="int", t={"type": "stateful_timestamp", "start": 0, "increment": 5})
    parts = synth(spark, spec, 60, seed=2).union(synth(spark, spec, 40, seed=2, start=60))
    assert sorted(parts.collect()) == sorted(synth(spark, spec, 100, seed=2).collect())


def test_function_and_object_api_agree(spark):
    spec = obj(users={"type": "array", "min_items": 2, "child": obj(id="int", name={"type": "string", "string_type": "name"}, active="bool")})
    assert synth(spark, spec, 3, 123).collect() == Engine(spark, 123).table(spec, 3).collect()


def test_bundled_specs_build(spark):
    for spec in (EVERY_NODE, READINGS, SHIPMENTS):
        df = synth(spark, spec, 50, seed=123, now=NOW)
        assert df.count() == 50
        for f in df.schema.fields:
            want = S.data_type(S.load(spec)["fields"][f.name])
            assert f.dataType.simpleString() == want.simpleString()


def test_smoke_values_pass_type_check(spark):
    df = synth(spark, EVERY_NODE, 500, seed=9, now=NOW)
    keep = ["berth", "draught", "flag", "call_sign", "pilot"]
    report = detect.type_check(df, obj(**{k: EVERY_NODE["fields"][k] for k in keep})).collect()
    assert all(r["wrong_type"] == 0 and r["out_of_domain"] == 0 for r in report)


def test_variant_when_types_differ(spark):
    df = synth(spark, EVERY_NODE, 200, seed=1, now=NOW)
    assert isinstance(df.schema["cargo"].dataType, T.VariantType)
    kinds = {r[0] for r in df.select(F.schema_of_variant("cargo")).distinct().collect()}
    assert kinds == {"BIGINT", "STRING"}


def test_bound_fields_follow_their_anchor(spark):
    spec = obj(pid={"type": "string", "template": "P-{nn}", "n_type": "numeric"},
               name={"type": "string", "string_type": "name", "bound_to": "pid"},
               blood={"type": "enum", "values": list("abcdefgh"), "linked_to": "pid"}, free="int")
    df = synth(spark, spec, 5000, seed=4)
    worst = df.groupBy("pid").agg(F.countDistinct("name", "blood").alias("n"), F.countDistinct("free").alias("f")).agg(
        F.max("n"), F.min("f")).first()
    assert worst[0] == 1 and worst[1] > 1


def test_pool_chain_has_no_orphans(spark):
    users = synth(spark, obj(user_id={"type": "string", "template": "U-{nnnn}", "n_type": "numeric", "pool": ["tier"]},
                             tier={"type": "enum", "values": ["a", "b", "c"], "bound_to": "user_id"}), 500, seed=1)
    pool = link.pool_build(users, "user_id", ["tier"])
    orders = synth(spark, obj(order_id={"type": "int", "max": 10**6}, user_id={"type": "string", "depends_on_pool": "u"},
                              tier={"type": "string", "depends_on_pool": "u"}), 3000, seed=2, pools={"u": pool})
    audit = link.fk_audit(orders, pool, "user_id", "user_id", {"tier": "tier"}).first()
    assert (audit["rows"], audit["orphans"], audit["mismatches"]) == (3000, 0, 0)


def test_empty_pool_and_missing_field_are_errors(spark):
    child = obj(a={"type": "int", "depends_on_pool": "p"})
    with pytest.raises(Exception, match="pool 'p' is empty"):
        synth(spark, child, 5, pools={"p": spark.range(0).withColumnRenamed("id", "a")}).collect()
    with pytest.raises(ValueError, match="no field"):
        synth(spark, child, 5, pools={"p": spark.range(3)})
    with pytest.raises(S.SpecError, match="no table"):
        synth(spark, child, 5)


def test_required_null_fails(spark):
    rec = {"type": "maybe", "p_null": 1, "child": "int"}
    with pytest.raises(Exception, match="required"):
        synth(spark, obj(r={**rec, "required": True}), 3).collect()
    assert [r[0] for r in synth(spark, obj(r={**rec, "default": 7}), 3).collect()] == [7, 7, 7]


def test_unparsable_sibling_time_fails(spark):
    spec = obj(a={"type": "string", "template": "not a time"}, b={"type": "timestamp", "depends_on": "a"})
    with pytest.raises(Exception, match="cannot parse"):
        synth(spark, spec, 2).collect()


@pytest.mark.parametrize("bad", [
    {"type": "array", "child": "int"}, obj(a={"type": "int", "min": 5, "max": 1}), obj(a={"type": "int", "step": 0}),
    obj(a={"type": "enum", "values": ["x"], "weights": [1, 2]}), obj(a={"type": "maybe", "p_null": 2, "child": "int"}),
    obj(a={"type": "array", "min_items": 3, "max_items": 1, "child": "int"}), obj(a={"type": "int", "colour": 1}),
    obj(a={"type": "nonsense"}), obj(a={"type": "int", "pool": True}, b={"type": "int", "pool": True}),
    obj(a={"type": "int", "bound_to": "zzz"}), obj(a={"type": "select", "options": {"x": {"of": "int"}}, "pick": {"mode": "exact"}})])
def test_contract_errors(bad):
    with pytest.raises(S.SpecError):
        S.load(bad)


def test_cycles_and_unsupported_syntax_are_refused(spark):
    with pytest.raises(S.SpecError, match="cyclic"):
        synth(spark, obj(a={"type": "timestamp", "depends_on": "b"}, b={"type": "datetime", "depends_on": "a"}), 1)
    for pattern in ("(?=x)y", r"(a)\1", "[^ -~]"):
        with pytest.raises(S.SpecError):
            synth(spark, obj(a={"type": "string", "regex": pattern}), 1)
    with pytest.raises(ValueError, match="directive"):
        synth(spark, obj(a={"type": "datetime", "format": "%Q"}), 1)


@pytest.mark.parametrize("pattern", ["a*b+c?", "[^a-y]{3,}", r"\\D\\W\\S", ".{40}", "(ab|[^c]){2,30}", "([a-c]{1,20};){17,19}", r"x\\d{1000}", "[^z]"])
def test_open_regexes_are_matched(spark, pattern):
    pattern = pattern.replace("\\\\", "\\")
    made = [r["a"] for r in synth(spark, obj(a={"type": "string", "regex": pattern}), 200).collect()]
    assert all(re.fullmatch(pattern, m, re.S) for m in made)
    assert len(set(made)) > 50 or pattern in ("a*b+c?",)


def test_loose_specs_normalise():
    node = S.load({"type": "record", "fields": {"a": "integer", "b": {"type": "list", "child": "str"}, "c": {"type": "int", "pool": True},
                                                "d": {"type": "int", "pool": False}}})
    assert node["fields"]["a"]["type"] == "int" and node["fields"]["b"]["child"]["type"] == "string"
    assert node["fields"]["c"]["pool"] == [] and "pool" not in node["fields"]["d"]
    assert set(S.flatten(node)) == {"a", "b", "b[]", "c", "d"}


def test_custom_generator(spark):
    S.register_generator("pair", lambda node, draw, path, key: F.concat(F.lit(node["tag"]), F.lit("-x")), T.StringType())
    assert synth(spark, obj(a={"type": "pair", "tag": "q"}), 1).first()["a"] == "q-x"


def test_keyed_by_any_column(spark):
    base = spark.createDataFrame([("k1",), ("k2",)], "k string")
    a = synth_over(base, obj(v={"type": "int", "max": 10**9}), "k", 3, row="k", keep=["k"]).collect()
    b = synth_over(base.where("k = 'k2'"), obj(v={"type": "int", "max": 10**9}), "k", 3, row="k", keep=["k"]).collect()
    assert b[0] in a
