"""Faults inside JSON texts against Python's parser: exact paths, nothing else touched."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from synthloom.functions import spans as P
from synthloom.functions.draw import Draw
from synthloom.functions.jsons import json_nodes
from synthloom.operators import drift as V
from synthloom.operators import faults as X
from synthloom.operators import json_faults as J
from synthloom.operators.infer import infer_spec, infer_table

D = Draw(11)
KEYS = ["a", "b.c", "e[]", 'q"x', "", "__meta", "k1", "é😀", "\\"]


def value(rng: random.Random, depth: int):
    kind = rng.random()
    if depth < 7 and kind < 0.35:
        return {k: value(rng, depth + 1) for k in rng.sample(KEYS, rng.randrange(4))}
    if depth < 7 and kind < 0.6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, -2.5e-3, True, None, "", "plain text", 'q"uo\\te\n', "é中😀", "[{,:}]"])


def texts(n: int) -> list[str]:
    rng = random.Random(4)
    out = []
    for _ in range(n):
        v = {"top": value(rng, 0), "list": [value(rng, 1), value(rng, 1)], "s": "some text"}
        out.append(json.dumps(v, ensure_ascii=rng.random() < 0.3, indent=rng.choice([None, 1]), separators=rng.choice([(",", ":"), (" , ", " : ")])))
    return [*out, "[]", "{}", '"s"', " 12 ", '{"a":' * 60 + "1" + "}" * 60, json.dumps({"x": ["y" * 3000] * 40}), "{bad", '{"a":1', "", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts(100))), "row_id int, doc string").repartition(8).cache()


def name(key: str) -> str:
    return "." + (key if re.fullmatch(r"[A-Za-z_]\w*", key, re.A) else json.dumps(key, ensure_ascii=False))


def nodes(v, path: str = ""):
    """(path, value, parent, key or index) of all nodes, in order of the text."""
    todo = [(path, v, None, None)]
    while todo:
        p, x, parent, at = todo.pop(0)
        yield p.lstrip("."), x, parent, at
        if isinstance(x, dict):
            todo[:0] = [(p + name(k), y, x, k) for k, y in x.items()]
        elif isinstance(x, list):
            todo[:0] = [(f"{p}[{i}]", y, x, i) for i, y in enumerate(x)]


def loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def same_name(path: str) -> str:
    """Paths compare by what their quoted keys stand for."""
    return re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: json.dumps(json.loads(m[0]), ensure_ascii=False), path)


def test_spans_equal_the_parser(docs):
    t = F.col("t")
    found = docs.where(F.try_parse_json("doc").isNotNull()).withColumn("t", P.tokens(F.col("doc"))).select("doc", F.transform(
        P.indices(t, P.is_value), lambda i: F.struct(P.path(F.col("doc"), t, i).alias("p"), P.node_text(F.col("doc"), t, i).alias("x"))).alias("n"))
    checked = 0
    for r in found.collect():
        want = list(nodes(json.loads(r["doc"])))
        assert [same_name(n["p"]) for n in r["n"]] == [p for p, *_ in want]
        assert [json.loads(n["x"]) for n in r["n"]] == [x for _, x, *_ in want]
        checked += len(want)
    assert checked > 1000


def drop(v, paths: set[str]):
    for p, _, parent, at in list(nodes(v)):
        if p in paths:
            parent.pop(at)
    return v


def test_lost_keys(docs):
    bad = docs.withColumnRenamed("doc", "old").withColumn("doc", F.col("old"))
    depths = set()
    for r in J.partial_load_json(bad, D, "row_id", "doc", p=0.8, max_keys=6).collect():
        paths = {same_name(p) for p in r["_missing"]}
        if not paths:
            assert r["doc"] == r["old"] and not r["_faults"]
            continue
        assert json.loads(r["doc"]) == drop(json.loads(r["old"]), paths) and not any(p.endswith("__meta") for p in paths)
        depths |= {p.count(".") + p.count("[") for p in paths}
    assert max(depths) >= 5


def strings(text) -> dict[str, object]:
    return {p: x for p, x, *_ in nodes(json.loads(text)) if not isinstance(x, (dict, list))}


def test_damaged_strings(docs):
    bad = docs.withColumnRenamed("doc", "old").withColumn("doc", F.col("old"))
    hits = 0
    for r in J.corrupt_json_text(bad, D, "row_id", "doc", p=0.9, min_fields=2, max_fields=3).collect():
        if loads(r["old"]) is None or not r["_faults"]:
            assert r["doc"] == r["old"]
            continue
        old, new = strings(r["old"]), strings(r["doc"])
        changed = [p for p in old if old[p] != new[p]]
        noted = re.fullmatch(r"corrupt_text\(doc (.*)\)", r["_faults"][0], re.S)[1]
        assert list(old) == list(new) and 1 <= len(changed) <= 3 and all(isinstance(old[p], str) for p in changed)
        assert len(re.findall(r" (?:replacement|delete|swap|zero_width|homoglyph|fullwidth|append_ff|insert_conf|accent)(?:, |$)", noted)) == len(changed)
        hits += 1
    assert hits > 70


def test_cut_nodes_and_renamed_keys_and_growth(docs):
    bad = docs.withColumnRenamed("doc", "old").withColumn("doc", F.col("old"))
    for r in J.truncate_json_nodes(bad, D, "row_id", "doc", p=1.0, max_nodes=2).collect():
        if loads(r["old"]) is None:
            assert r["doc"] == r["old"]
        elif "truncate_json(doc :" in r["_faults"][0]:
            assert r["old"].strip().startswith(r["doc"].strip())
        else:
            old, new = dict((p, x) for p, x, *_ in nodes(json.loads(r["old"]))), dict((p, x) for p, x, *_ in nodes(json.loads(r["doc"])))
            cut = [p for p in new if new[p] != old.get(p) and isinstance(new[p], str)]
            assert 1 <= len(cut) <= 2
    for r in J.corrupt_key(bad, D, "row_id", "doc", p=1.0, max_keys=2).collect():
        if loads(r["old"]) is None or not r["_faults"]:
            assert r["doc"] == r["old"]
        else:
            assert len(list(nodes(json.loads(r["doc"])))) == len(list(nodes(json.loads(r["old"])))) and r["doc"] != r["old"]
    for strategy in ("insert", "repeat"):
        for r in J.bloat_json(bad, D, "row_id", "doc", p=1.0, extra_kb=1, strategy=strategy).collect():
            if r["_faults"]:
                old, new = strings(r["old"]), strings(r["doc"])
                assert [len(new[p]) - len(old[p]) for p in old if old[p] != new[p]] == [1024]
            else:
                assert r["doc"] == r["old"]


def test_chained_faults_stay_narrow(spark):
    bad = spark.createDataFrame(list(enumerate(texts(100))), "row_id int, doc string")
    for op in (J.partial_load_json, J.corrupt_key, J.corrupt_json_text, J.truncate_json_nodes):
        bad = op(bad, D, "row_id", "doc", p=0.5)
    assert "Exchange" not in bad.where("doc <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert bad.where("size(_faults) > 1").count() > 20


def test_null_elements_are_not_nulled_again(spark):
    df = spark.createDataFrame([(i, [{"b": None}, {"b": i}, {"b": None}]) for i in range(40)], "row_id int, arr array<struct<b:int>>")
    bad = X.null_field(df, D, "row_id", fields=["arr[].b"], p=1.0).collect()
    assert all(r["_faults"] == ["null_field(arr[].b)"] and [x["b"] for x in r["arr"]] == [None] * 3 for r in bad)


def walk(v, steps=()):
    yield steps, v
    for k, x in (v.items() if isinstance(v, dict) else ((None, y) for y in v) if isinstance(v, list) else ()):
        yield from walk(x, (*steps, k))


def test_walk_equals_the_parser(docs):
    """All nodes at any depth, list elements and odd keys included; malformed texts are told."""
    want: dict = {}
    for r in docs.collect():
        if r["doc"] is None:
            continue
        own = loads(r["doc"])
        for steps, v in [(None, None)] if own is None and r["doc"] != "null" else walk(own):
            kind = "malformed" if steps is None else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else None
            key = (steps, kind, len(v) if kind == "array" else None)
            want[key] = want.get(key, 0) + 1
    got = json_nodes(docs, "doc", []).groupBy("steps", "kind", "items").count().collect()
    assert {(None if r["steps"] is None else tuple(r["steps"]), r["kind"], r["items"]): r["count"] for r in got} == want
    assert max(len(s) for s, *_ in want if s) == 60


def test_spec_sees_every_field_and_element(spark):
    df = spark.createDataFrame([(0, '{"a.b":1,"c":{"x y":[[1.5],["z"]]},"e[]":3,"l":[1,"x",2.5]}'), (1, "{bad"), (2, '{"l":["y"],"new":null}'), (3, None)],
                               "i long, doc string")
    table = {r["path"]: (r["type"], r["n"], r["kinds"]) for r in infer_table(df, "doc", "i").collect()}
    assert table == {"": ("object", 2, 1), '"a.b"': ("int", 1, 1), "c": ("object", 1, 1), 'c."x y"': ("array", 1, 1), 'c."x y"[]': ("array", 2, 1),
                     'c."x y"[][]': ("float", 1, 2), '"e[]"': ("int", 1, 1), "l": ("array", 2, 1), "l[]": ("string", 2, 3), "new": ("maybe", 1, 1),
                     None: ("malformed", 1, 1)}
    spec = infer_spec(df, "doc", "i")
    assert list(spec["fields"]) == ["a.b", "c", "e[]", "l", "new"] and spec["fields"]["l"]["max_items"] == 3
    first = {r["path"]: r["type"] for r in infer_table(df, "doc", "i", first_element=True).collect()}
    assert first["l[]"] == "int" and first['c."x y"[][]'] == "float"
    by_name = infer_table(df.select(F.col("i").cast("string").alias("i"), "doc"), "doc", "i")
    assert {r["path"]: (r["type"], r["n"], r["kinds"]) for r in by_name.collect()} == table


def test_renames_are_told_from_drop_and_add(spark):
    before = spark.createDataFrame([(i, json.dumps({"id": i, "a.b": f"name {i}", "x": i % 7, "same": 1, "y": i})) for i in range(300)], "i long, doc string")
    after = spark.createDataFrame([(i, json.dumps({"id": i, "c": f"name {i}" if i % 5 else "other", "z": i % 7, "same": "text", "w": -i - 1})) for i in range(300)],
                                  "i long, doc string")
    got = {r["path"]: (r["change"], r["moved_from"], r["ratio"]) for r in V.schema_diff_rows(before, after, "doc", "i", D, 0.5).collect()}
    assert set(got) == {"c", "z", "same", "w", "y"}
    assert got["c"][:2] == ("renamed", '"a.b"') and 0.5 < got["c"][2] < 1.0
    assert got["z"] == ("renamed", "x", 1.0) and got["same"][0] == "retyped" and got["w"][0] == "added" and got["y"][0] == "dropped"
