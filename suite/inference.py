"""Spec inference from JSON made of the given rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import SEED, Suite, table, u
from synthloom.operators import infer as I
from synthloom.sources.synth import synth_over

suite = Suite()


LEVELS = 10
DEEP = '{"d":' * LEVELS + '"x@y.z"' + "}" * LEVELS


def docs(spark, sf):
    """A text per event: keys with dots and brackets, a mixed list, ten levels; those of user 7 are cut off."""
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    user = F.col("user_id").cast("string")
    who = F.when(F.col("user_id") < 50, F.concat(F.lit("u"), user, F.lit("@example.com"))).otherwise(user)
    tags = F.when(F.col("value") > 50, F.lit(',"tags":["a","b"]')).when(F.col("value") > 20, F.lit(',"tags":[1]')).otherwise("")
    mix = F.when(F.col("event_type") == "click", "null").when(F.col("event_type") == "view", "1.5").otherwise('"http://x"')
    whole = F.concat(
        F.lit('{"id":'), "event_id", F.lit(',"v":'), amount, F.lit(',"type":"'), "event_type", F.lit('","who":"'), who,
        F.lit('","props":'), "props", tags, F.lit(',"mix":'), mix, F.lit(',"a.b":true,"e[]":[1,"x",2.5,{"k":'), "user_id",
        F.lit('}],"deep":' + DEEP + "}"))
    return table(spark, sf, "events").select("event_id", F.when(F.col("user_id") == 7, F.substring(whole, 1, 9)).otherwise(whole).alias("doc"))


def _rows(path, kind, detail="NULL", num="NULL", items="NULL", where="true"):
    return (f"SELECT event_id, '{path}' AS path, {kind} AS type, {detail} AS detail, ({num})::DOUBLE AS num, ({items})::BIGINT AS items "
            f"FROM events WHERE user_id <> 7 AND {where}")


NODES = " UNION ALL ".join([
    _rows("", "'object'"), _rows("id", "'int'", num="event_id"), _rows("v", "'float'", num="value::DECIMAL(18,2)"),
    _rows("type", "'string'"), _rows("who", "'string'", "CASE WHEN user_id < 50 THEN 'email' ELSE 'digits' END"),
    _rows("props", "'object'"), _rows("props.k", "'int'", num="(props->>'$.k')::INT"),
    _rows("tags", "'array'", items="CASE WHEN value > 50 THEN 2 ELSE 1 END", where="value > 20"),
    _rows("tags[]", "CASE WHEN value > 50 THEN 'string' ELSE 'int' END", num="CASE WHEN value <= 50 THEN 1 END", where="value > 20"),
    _rows("tags[]", "'string'", where="value > 50"),
    _rows("mix", "CASE event_type WHEN 'click' THEN 'maybe' WHEN 'view' THEN 'float' ELSE 'string' END",
          "CASE WHEN event_type NOT IN ('click','view') THEN 'url' END", "CASE WHEN event_type = 'view' THEN 1.5 END"),
    _rows('"a.b"', "'bool'"), _rows('"e[]"', "'array'", items="4"), _rows('"e[]"[]', "'int'", num="1"), _rows('"e[]"[]', "'string'"),
    _rows('"e[]"[]', "'float'", num="2.5"), _rows('"e[]"[]', "'object'"), _rows('"e[]"[].k', "'int'", num="user_id"), _rows("deep", "'object'"),
    *[_rows("deep" + ".d" * k, "'object'") for k in range(1, LEVELS)], _rows("deep" + ".d" * LEVELS, "'string'", "'email'"),
    "SELECT event_id, NULL, 'malformed', NULL, NULL, NULL FROM events WHERE user_id = 7"])


@suite.add("i1_infer_value_type", NODES)
def infer_value_type(spark, sf):
    return I.infer_value_type(docs(spark, sf), "doc", "event_id")


@suite.add("i2_infer_spec", f"""
WITH n AS ({NODES}),
t AS (SELECT path, type, count(*) AS n, min(event_id) AS first_seen, arg_min({{'d': detail}}, event_id).d AS detail, min(num) AS min, max(num) AS max,
 min(items) AS min_items, max(items) AS max_items FROM n GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY path) AS kinds FROM t QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, first_seen, type) = 1""")
def infer_spec(spark, sf):
    return I.infer_table(docs(spark, sf), "doc", "event_id").drop("steps")


@suite.add("i2_first_elements", f"""
WITH n AS ({NODES}) SELECT path, type, count(*) AS n FROM n
WHERE path NOT LIKE '"e[]"[].%' AND NOT (path = '"e[]"[]' AND type <> 'int') AND NOT path = 'tags[]' GROUP BY 1, 2
UNION ALL SELECT 'tags[]', CASE WHEN value > 50 THEN 'string' ELSE 'int' END, count(*) FROM events WHERE user_id <> 7 AND value > 20 GROUP BY 1, 2
UNION ALL SELECT NULL, 'malformed', count(*) FROM events WHERE user_id = 7 HAVING count(*) > 0""")
def first_elements(spark, sf):
    nodes = I.infer_value_type(docs(spark, sf), "doc", "event_id", first_element=True)
    return nodes.groupBy("path", "type").agg(F.count("*").alias("n"))


@suite.add("i3_infer_sample", f"""
WITH n AS ({NODES}), s AS (SELECT event_id FROM events ORDER BY event_id LIMIT 1000)
SELECT path, type, count(*) AS n FROM n SEMI JOIN s USING (event_id) GROUP BY 1, 2""")
def infer_sample(spark, sf):
    nodes = I.infer_value_type(I.infer_sample(docs(spark, sf), "event_id", 1000), "doc", "event_id")
    return nodes.groupBy("path", "type").agg(F.count("*").alias("n"))


@suite.add("i4_roundtrip", f"""
WITH r AS (SELECT min((props->>'$.k')::BIGINT) AS lo, max((props->>'$.k')::BIGINT) AS hi FROM events)
SELECT event_id, lo+floor({u('k', 'event_id')}*(hi-lo+1)::DOUBLE)::BIGINT AS k FROM events, r""")
def roundtrip(spark, sf):
    events = table(spark, sf, "events")
    spec = I.infer_spec(events, "props", "event_id")
    return synth_over(events, spec, "event_id", SEED, keep=["event_id"], kind="portable")
