"""Plan checks: no Python on the batch path, no cartesian products, filters and columns reach the scan."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from suite.common import table
from suite.specs import SHIPMENTS, FLAT
from synthloom.operators import detect, link
from synthloom.operators.infer import infer_spec
from synthloom.plans import drift as P, spec as S
from synthloom.sources.synth import synth, synth_over

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


QUERIES = {n: q for n, q in entry.queries().items() if n not in entry.LLM and not n.endswith("_stream")}


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_cartesian(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_synthesis_is_one_stage(spark):
    text = plan(synth(spark, SHIPMENTS, 1000, now="2025-01-01"))
    assert "Exchange" not in text and "Range" in text


def test_only_used_columns_are_made(spark):
    text = plan(synth(spark, FLAT, 1000, now="2025-01-01").select("count"))
    assert "|city" not in text and "city#null" not in text and "|amount" not in text


def test_filters_and_columns_reach_the_scan(spark):
    orders = table(spark, SF, "orders")
    text = plan(synth_over(orders.where("o_orderkey < 10"), FLAT, "o_orderkey", now="2025-01-01"))
    assert "LessThan(o_orderkey,10)" in text and "ReadSchema: struct<o_orderkey:bigint>" in text
    text = plan(detect.duplicate_elements_report(
        table(spark, SF, "embeddings"), "vec_id", "embedding"))
    assert "label" not in text.split("ReadSchema")[1].split("\n")[0]


def test_fk_audit_aggregates_before_the_join(spark):
    text = plan(link.fk_audit(table(spark, SF, "orders"), table(spark, SF, "customer"), "o_custkey", "c_custkey"))
    assert text.index("Join") < text.index("HashAggregate") or "HashAggregate" in text.split("Join")[1]


def test_structure_drift_keeps_specs_valid():
    spec, done = FLAT, []
    for seed in range(40):
        plan = P.plan_structure(spec, seed, steps=2, keep=("id",))
        assert plan == P.plan_structure(spec, seed, steps=2, keep=("id",))
        spec = S.load(P.apply_edits(spec, plan))
        done += plan
    assert {"add", "drop", "rename"} <= {e.action for e in done} and "id" in spec["fields"]
    nested = {"type": "object", "fields": {"a": {"type": "object", "fields": {"b": "int"}}, "a_b": "bool"}}
    flat = P.apply_edits(nested, [P.Edit("flatten", ("a",))])["fields"]
    assert {k: v["type"] for k, v in flat.items()} == {"a_b": "bool", "a_b_": "int"}
    bound = P.apply_edits(FLAT, [P.Edit("rename", ("at",), "when"), P.Edit("drop", ("when",))])["fields"]
    assert "depends_on" not in bound["day"] and "when" not in bound


def test_value_drift_is_reproducible_and_bounded(spark):
    want = {"int": {"shift": (5, 5), "nulls": (0.3, 0.3)}, "enum": {"only": True}, "maybe": {"move": (0.1, 0.1)},
            "float": {"share": (0.5, 0.5)}, "timestamp": {"shift": (-3600, -3600)}}
    plan = P.plan_values(FLAT, 3, want)
    assert plan == P.plan_values(FLAT, 3, want) and plan
    got = P.apply_edits(FLAT, plan)["fields"]
    assert got["count"]["type"] == "maybe" and got["count"]["p_null"] == 0.3
    assert (got["count"]["child"]["min"], got["count"]["child"]["max"]) == (6, 105)
    assert sorted(got["tier"]["weights"]) == [0.0, 0.0, 1.0] and abs(got["city"]["p_null"] - 0.3) < 1e-9
    assert (got["amount"]["min"], got["amount"]["max"]) == (252.5, 747.5)
    assert got["at"]["start"] == "2023-02-28T23:00:00+00:00"
    assert synth(spark, {"type": "object", "fields": got}, 100, now="2025-01-01").count() == 100


def test_layers_expire_and_respect_limits():
    wanted = [P.Layer(10, "a", "s", 5), P.Layer(12, "b", "s"), P.Layer(12, "c", "d", 2)]
    got = P.accept(wanted, most_per_kind=1)
    assert [x.version for x in got] == ["a", "c"]
    assert P.intervals(got, 30) == [(0, 10, "base"), (10, 12, "a"), (12, 14, "c"), (14, 17, "a"), (17, 30, "base")]
    assert P.intervals([P.Layer(0, "a"), P.Layer(5, "b")], 9) == [(0, 5, "a"), (5, 9, "b")]
    assert [x.version for x in P.accept(wanted, most=1)] == ["a"]


def test_inferred_spec_round_trips(spark):
    docs = spark.createDataFrame([
        (1, '{"id": 5, "tags": ["a"], "o": {"x": 1.5}, "mail": "a@b.c", "n": null, "d": "123"}'),
        (2, '{"id": 9, "tags": ["b", "c"], "o": {"x": 2.5, "y": true}, "mail": "d@e.f", "n": null, "d": "9"}'),
        (3, '{"id": "x", "tags": [], "o": {"x": 0.5}, "u": "https://a.b"}')], "n int, doc string")
    spec = infer_spec(docs, "doc", "n")
    f = spec["fields"]
    assert f["id"] == {"type": "int", "min": 5, "max": 9} and (f["tags"]["min_items"], f["tags"]["max_items"]) == (0, 2)
    assert f["o"]["fields"]["x"]["min"] == 0.5 and f["o"]["fields"]["y"] == {"type": "bool"}
    assert f["mail"]["string_type"] == "email" and f["u"]["string_type"] == "url" and f["n"]["type"] == "maybe"
    made = synth(spark, spec, 200)
    assert made.where(~F.col("id").between(5, 9) | ~F.col("d").rlike(r"^\d+$")).count() == 0
    assert infer_spec(spark.createDataFrame([(1, '[1,[2]]')], "n int, doc string"), "doc", "n", first_element=True)["child"]["type"] == "int"
    assert infer_spec(spark.createDataFrame([(1, '[[2],1,2]')], "n int, doc string"), "doc", "n")["child"]["type"] == "int"


def test_deep_json_is_walked_to_its_end(spark):
    doc = '{"a":' * 12 + "1" + "}" * 12
    found = detect.key_profile(spark.createDataFrame([(doc,)], "doc string"), "doc").collect()
    assert {r["path"]: r["present"] for r in found} == {".".join("a" * k): 1 for k in range(1, 13)}


def test_chained_lookups_scan_the_table_once(spark, tmp_path):
    from synthloom.session import lookup_join
    spark.range(100).selectExpr("id", *[f"id % {k + 2} as k{k}" for k in range(4)]).write.parquet(str(tmp_path / "facts"))
    df = spark.read.parquet(str(tmp_path / "facts"))
    for k in range(4):
        names = spark.range(9).select(F.col("id").alias(f"k{k}"), F.concat(F.lit("n"), "id").alias(f"name{k}"))
        df = lookup_join(df, names, [f"k{k}"])
    text = plan(df)
    assert text.split("\n\n")[0].count("Scan parquet") == 1 and df.count() == 100


def test_sums_keep_small_and_large_numbers(spark):
    from synthloom.operators import metrics
    small = spark.range(1000).selectExpr("'a' as g", "1e-7D as v")
    assert abs(metrics.labelled_counter(small, ["g"], "v").first()["total"] - 1e-4) < 1e-15
    large = spark.range(3).selectExpr("'a' as g", "1e23D as v")
    assert metrics.labelled_counter(large, ["g"], "v").first()["total"] == pytest.approx(3e23)
    cents = spark.range(1000).selectExpr("'a' as g", "0.1D as v")
    assert metrics.labelled_counter(cents, ["g"], "v").first()["total"] == 100.0
    assert metrics.labelled_counter(cents.selectExpr("g", "cast(null as double) v"), ["g"], "v").first()["total"] is None
