"""Detectors on the given tables, clean and damaged."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import faults as FS
from suite.columns import K, dbl, over_orders
from suite.common import SEED, Suite, below, table, text, u
from synthloom.functions import lists as L
from synthloom.functions.draw import Draw
from synthloom.operators import detect as Q, faults as X

suite = Suite()
D = Draw(SEED, kind="portable")
E = "event_id"

_D1 = [("id", "0", "1"), ("big", "(value <= 100)::INT", "1"), ("s", "(event_type = 'click')::INT", "1"),
       ("s.u", "(event_type = 'click' OR user_id <= 10)::INT", "1"), ("arr", "0", "1"),
       ("arr[]", "(value <= 50)::INT", "2"), ("arr[].v", "(user_id <= 10)::INT + (value <= 50)::INT", "2")]


@suite.add("d1_null_profile", " UNION ALL ".join(
    f"SELECT '{p}' AS path, sum({n})::BIGINT AS nulls, sum({t})::BIGINT AS total FROM events" for p, n, t in _D1))
def null_profile(spark, sf):
    some = F.when(F.col("user_id") > 10, F.col("user_id"))
    df = table(spark, sf, "events").select(
        F.col(E).alias("id"), F.when(F.col("value") > 100, F.col("value")).alias("big"),
        F.when(F.col("event_type") != "click", F.struct(some.alias("u"))).alias("s"),
        F.array(F.struct(some.alias("v")), F.when(F.col("value") > 50, F.struct(F.col(E).alias("v")))).alias("arr"))
    return Q.null_profile(df)


@suite.add("d2_key_profile", """
SELECT * FROM (SELECT 'p' AS path, count(*) AS present FROM events WHERE event_type <> 'error' UNION ALL
 SELECT unnest(['p.k', '"a.b"', '"e[]"', 'x', 'x.y', 'x.y[][].z']), count(*) FROM events WHERE event_type <> 'error' UNION ALL
 SELECT unnest(['big','big[].x','big[].y']), count(*) FROM events WHERE value > 50 AND event_type <> 'error' UNION ALL
 SELECT NULL, count(*) FROM events WHERE event_type = 'error') WHERE present > 0""")
def key_profile(spark, sf):
    big = F.when(F.col("value") > 50, F.lit(',"big":[{"x":1},{"y":null}]')).otherwise("")
    end = F.when(F.col("event_type") == "error", "").otherwise("}")
    df = table(spark, sf, "events").select(F.concat(
        F.lit('{"a.b":1,"e[]":[],"x":{"y":[[],[{"z":[]}]]},"p":'), "props", big, end).alias("doc"))
    return Q.key_profile(df, "doc")


@suite.add("d3_duplicate_rows_report", """
SELECT sha256('{"lang":'||to_json(lang)||',"text":'||to_json(text)||'}') AS digest, count(*) AS copies
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_rows_report(spark, sf):
    return Q.duplicate_rows_report(table(spark, sf, "documents"), ["text", "lang"])


@suite.add("d4_duplicate_elements_report", """
SELECT doc_id, len(w) AS elements, len(list_distinct(w)) AS distinct_elements FROM (
 SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) > len(list_distinct(w))""")
def duplicate_elements_report(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    return Q.duplicate_elements_report(df, "doc_id", "words")


@suite.add("d5_truncated_json_report", """
WITH t AS (SELECT CASE event_type WHEN 'click' THEN substr(props, 1, 5) WHEN 'error' THEN props||'x' ELSE props END AS p FROM events)
SELECT count(p) AS texts, count_if(p LIKE '{%' AND p NOT LIKE '%}') AS unclosed, count_if(NOT json_valid(p)) AS invalid FROM t""")
def truncated_json_report(spark, sf):
    p = (F.when(F.col("event_type") == "click", F.substring("props", 1, 5))
         .when(F.col("event_type") == "error", F.concat("props", F.lit("x"))).otherwise(F.col("props")))
    return Q.truncated_json_report(table(spark, sf, "events").select(p.alias("p")), "p")


_D6 = [(n, f"length(text)-length(translate(text, {text(c)}, ''))") for n, c in Q.SUSPECT.items()]
_D6.append(("mixed_script", "len(regexp_extract_all(text, " + f"'[A-Za-z]['||{text(L.HOMOGLYPH_TO)}||']|['||{text(L.HOMOGLYPH_TO)}||'][A-Za-z]'))"))


@suite.add("d6_encoding_report", f"WITH bad AS MATERIALIZED ({FS.suite.sql['f9_corrupt_text']})" + " UNION ALL ".join(
    f" SELECT 'text' AS \"column\", '{n}' AS class, count_if(x > 0) AS rows, sum(x)::BIGINT AS chars FROM (SELECT {e} AS x FROM bad)"
    for n, e in _D6))
def encoding_report(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return Q.encoding_report(X.corrupt_text(df, D, "doc_id", p=0.5), ["text"])


@suite.add("d7_late_report", f"""
WITH bad AS ({FS.suite.sql['f13_late_arrival']}),
w AS (SELECT e.user_id, event_id, us, max(us) OVER (PARTITION BY user_id ORDER BY event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM bad JOIN events e USING (event_id))
SELECT user_id, event_id, us, seen-us AS late_by FROM w WHERE us < seen""")
def late_report(spark, sf):
    df = X.late_arrival(table(spark, sf, "events"), D, E, "ts", late_window_seconds=7200, p=0.1)
    df = df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return Q.late_report(df, "us", E, "user_id", width=1_000)


@suite.add("d8_sequence_gap_report", """
WITH d AS (SELECT user_id, event_id, epoch_us(ts)//86400000000 AS day FROM events),
w AS (SELECT *, day-lag(day) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM d)
SELECT * FROM w WHERE step <> 1""")
def sequence_gap_report(spark, sf):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    df = table(spark, sf, "events").select("user_id", E, day.alias("day"))
    return Q.sequence_gap_report(df, "user_id", E, "day", 1, width=1_000)


@suite.add("d9_type_check", """
WITH t AS (SELECT CASE WHEN event_type = 'error' THEN 'x'||user_id ELSE user_id::VARCHAR END AS user_id,
 CASE WHEN value > 150 THEN NULL ELSE value END AS value, event_type, props FROM events)
SELECT 'user_id' AS field, 'bigint' AS type, count(*) AS rows, 0::BIGINT AS nulls, count_if(try_cast(user_id AS BIGINT) IS NULL) AS wrong_type,
 count_if(try_cast(user_id AS BIGINT) NOT BETWEEN 0 AND 50) AS out_of_domain FROM t
UNION ALL SELECT 'value', 'double', count(*), count_if(value IS NULL), 0, count_if(value NOT BETWEEN 0 AND 100) FROM t
UNION ALL SELECT 'event_type', 'string', count(*), 0, 0, count_if(event_type NOT IN ('click','view')) FROM t
UNION ALL SELECT 'props', 'string', count(*), 0, 0, count_if(NOT regexp_matches(props, '^\\{"k": [0-9]\\}$')) FROM t""")
def type_check(spark, sf):
    df = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "user_id")).otherwise(
            F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("value") <= 150, F.col("value")).alias("value"), "event_type", "props")
    return Q.type_check(df, {"type": "object", "fields": {
        "user_id": {"type": "int", "min": 0, "max": 50},
        "value": {"type": "maybe", "child": {"type": "float", "min": 0, "max": 100}},
        "event_type": {"type": "enum", "values": ["click", "view"]},
        "props": {"type": "string", "regex": '^\\{"k": [0-9]\\}$'}}})


SPEC = {"tier": {"type": "enum", "values": ["free", "pro", "enterprise"], "weights": [60, 30, 10]},
        "flag": {"type": "bool", "p_true": 0.3},
        "trace": {"type": "maybe", "p_null": 0.35, "child": {"type": "enum", "values": ["a", "b"]}}}
_T = f"{u('tier', K)}*{dbl(100)}"


def _share(field, value, declared, cond, base):
    seen = f"count_if({cond})::DOUBLE/count_if({base})"
    return (f"SELECT '{field}' AS field, '{value}' AS value, {dbl(declared)} AS declared, {seen} AS observed, "
            f"abs({seen}-{dbl(declared)}) <= {dbl(.02)} AS ok FROM t")


@suite.add("d10_distribution_check", f"""
WITH t AS (SELECT CASE WHEN {_T} <= {dbl(60)} THEN 'free' WHEN {_T} <= {dbl(90)} THEN 'pro' ELSE 'enterprise' END AS tier,
 {u('flag', K)} < {dbl(.3)} AS flag,
 CASE WHEN {u('trace#null', K)} >= {dbl(.35)} THEN ['a','b'][{below('trace.?', K, 2)}+1] END AS trace FROM orders)
""" + " UNION ALL ".join([
    _share("tier", "free", .6, "tier = 'free'", "true"), _share("tier", "pro", .3, "tier = 'pro'", "true"),
    _share("tier", "enterprise", .1, "tier = 'enterprise'", "true"), _share("flag", "true", .3, "flag", "true"),
    _share("trace", "null", .35, "trace IS NULL", "true"), _share("trace", "a", .5, "trace = 'a'", "trace IS NOT NULL"),
    _share("trace", "b", .5, "trace = 'b'", "trace IS NOT NULL")]))
def distribution_check(spark, sf):
    return Q.distribution_check(over_orders(spark, sf, SPEC), {"type": "object", "fields": SPEC})
