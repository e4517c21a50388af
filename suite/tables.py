"""Sources, sinks and linking operators on the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from suite.columns import K, dbl, padded, pick, rounded
from suite.common import SEED, Suite, below, table, u
from synthloom.functions import lists as L
from synthloom.operators import link
from synthloom.session import dense_position, keyed_position, persist_reliably, work_dir
from synthloom.sources import datasets as DS
from synthloom.sources import pregen, publish as P
from synthloom.sources.storelog import ClaimLedger
from synthloom.sources.synth import envelope, synth, synth_over, synth_stream

suite = Suite()
NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
NOW_US = 1706745600000000
DAY_US = 86_400_000_000

FLAT = {"type": "object", "fields": {
    "amount": {"type": "float", "min": 5, "max": 500, "precision": 2},
    "tier": {"type": "enum", "values": ["free", "pro", "enterprise"]},
    "city": {"type": "maybe", "p_null": 0.2, "child": {"type": "string", "string_type": "city"}},
    "tick": {"type": "stateful_timestamp", "start": 1704067200000000, "increment": 250000}}}
E_ = "event_id"
FLAT_SQL = (f"SELECT {rounded(f'{u("amount", E_)}*{dbl(495)}+{dbl(5)}', 2)} AS amount, "
            f"['free','pro','enterprise'][{below('tier', E_, 3)}+1] AS tier, "
            f"CASE WHEN {u('city#null', E_)} >= {dbl(.2)} THEN "
            f"{pick(L.CITIES, 'city.?#city').replace(K, E_)} END AS city, "
            f"1704067200000000+({E_}+1)*250000 AS tick FROM events")


@suite.add("s1_synth_table", FLAT_SQL)
def synth_table(spark, sf):
    """A record for each given row, its draws keyed by the row's id."""
    return synth_over(table(spark, sf, "events"), FLAT, "event_id", SEED, kind="portable")


@suite.add("s1_synth_slices", FLAT_SQL.replace("FROM events", "FROM events WHERE event_id < 5000") + " UNION ALL " + FLAT_SQL.replace(
    "FROM events", "FROM events WHERE event_id >= 5000"))
def synth_slices(spark, sf):
    """The same from two ranges of row numbers that are as long as the given table."""
    n = table(spark, sf, "events").agg(F.max("event_id") + 1).first()[0]
    half = min(n, 5000)
    return synth(spark, FLAT, half, SEED, kind="portable").unionByName(synth(spark, FLAT, n - half, SEED, start=half, kind="portable"))


def run_stream(sdf, label, mode="append"):
    """Drive a stream over the files at hand to its end and read what it wrote."""
    spark = sdf.sparkSession
    out = work_dir(spark, label)
    (sdf.writeStream.outputMode(mode).format("parquet")
     .option("path", out + "/data").option("checkpointLocation", out + "/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(sdf.schema).parquet(out + "/data")


def stream_table(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


@suite.add("s2_synth_stream", FLAT_SQL)
def synth_over_stream(spark, sf):
    rows = stream_table(spark, sf, "events").select("event_id")
    return run_stream(synth_over(rows, FLAT, "event_id", SEED, kind="portable"), "synth")


@suite.add("s2_synth_stream_restarts", FLAT_SQL.replace("SELECT", "SELECT event_id,", 1))
def synth_stream_restarts(spark, sf):
    """A stream of its own that ends after a micro-batch, started again until it has a row for each given one."""
    events = table(spark, sf, "events").select("event_id")
    n = events.agg(F.max("event_id") + 1).first()[0]
    out = work_dir(spark, "synth")
    sdf = synth_stream(spark, FLAT, -(-n // 3), SEED, max_rows=n, duration_ms=3000, kind="portable")
    for _ in range(4):
        (sdf.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/state")
         .trigger(availableNow=True).start().awaitTermination())
    made = spark.read.schema(sdf.schema).parquet(out + "/data").withColumnRenamed("seq", "event_id")
    return events.join(made, "event_id")


@suite.add("s3_pregen_write", "SELECT event_type AS schema, event_id, value, row_number() OVER ("
           "PARTITION BY event_type ORDER BY event_id)-1 AS row_id FROM events")
def pregen_write(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_type").alias("schema"), "event_id", "value")
    numbered = keyed_position(df, ["schema"], "event_id", "row_id")
    path = work_dir(spark, "pregen")
    pregen.pregen_write(numbered, path, "schema", "row_id", max_items=10**12)
    return spark.read.schema(numbered.schema).parquet(path)


@suite.add("s4_pregen_or_live", """
SELECT * FROM (SELECT 'ready' AS source, event_id, value FROM events WHERE event_type='purchase'
               ORDER BY event_id LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'live', event_id, value FROM events ORDER BY event_id LIMIT 100)""")
def pregen_or_live(spark, sf):
    live = table(spark, sf, "events").select(F.lit("live").alias("source"), "event_id", "value")
    ready = (table(spark, sf, "events").where("event_type = 'purchase'")
             .select(F.lit("ready").alias("source"), "event_id", "value"))
    empty = ready.where("value < 0")
    return (pregen.pregen_or_live(ready, live, 100, "event_id")
            .unionByName(pregen.pregen_or_live(empty, live, 100, "event_id")))


@suite.add("s4_take", """
WITH p AS (SELECT event_type AS schema, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)-1 AS row_id FROM events)
SELECT 'first' AS taker, * FROM p WHERE schema = 'purchase' AND row_id < 60 UNION ALL SELECT 'other', * FROM p WHERE schema = 'click' AND row_id < 30
UNION ALL SELECT unnest(['second', 'again']), * FROM p WHERE schema = 'purchase' AND row_id BETWEEN 60 AND 109
UNION ALL SELECT 'all', * FROM p WHERE schema = 'error' UNION ALL SELECT 'live', * FROM p WHERE schema = 'error' AND row_id < 20""")
def take(spark, sf):
    """Takers of prepared rows one after another: none gets another's, a repeated one gets its own again."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("schema"), "event_id")
    ready = persist_reliably(keyed_position(rows, ["schema"], "event_id", "row_id"))
    ledger = ClaimLedger(spark, work_dir(spark, "claims"))
    out = None
    for taker, schema, k, key in (("first", "purchase", 60, None), ("other", "click", 30, None), ("second", "purchase", 50, "s"),
                                  ("again", "purchase", 50, "s"), ("all", "error", 10**9, None), ("live", "error", 20, None)):
        part = ledger.take(ready, ready, schema, k, retry_key=key).withColumn("taker", F.lit(taker))
        out = part if out is None else out.unionByName(part)
    return out


@suite.add("s5_bounded_recent", """
SELECT user_id, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""")
def bounded_recent(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "value")
    return pregen.bounded_recent(df, "user_id", [F.col("event_id").desc()], 20)


def event_datasets(spark, sf, batch_size=100, keep=()):
    df = table(spark, sf, "events").select(
        F.col("event_type").alias("schema"), "event_id", "user_id",
        F.col("value").cast("decimal(18,2)").alias("value"), "props")
    numbered = keyed_position(df, ["schema"], "event_id", "seq")
    meta = DS.DatasetMeta(seed=SEED, created=NOW, spec={"type": "object"}, faults=["list_shuffle"])
    return DS.dataset_append(numbered, meta, "schema", "seq", batch_size)


DATASETS_CTE = f"""
numbered AS (SELECT event_type, event_id, user_id, value, props,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id)-1 AS seq FROM events),
datasets AS (SELECT md5(event_type||'|{SEED}|{NOW.isoformat()}|'||(seq//100)) AS id,
  event_type AS schema_name, '{{"items":['||string_agg('{{"event_id":'||event_id||',"user_id":'||user_id
   ||',"value":'||value::DECIMAL(18,2)||',"props":"'||replace(props,'"','\\"')||'"}}', ',' ORDER BY seq)||']}}' AS data,
  count(*) AS n, min(event_id) AS first_event FROM numbered GROUP BY event_type, seq//100)"""


@suite.add("s6_dataset_append", f"""WITH {DATASETS_CTE}
SELECT id, schema_name, data, {SEED}::BIGINT AS seed, substr(sha256('{{"type": "object"}}'),1,16) AS spec_hash,
 'list_shuffle' AS faults, {NOW_US}::BIGINT AS created_us, {NOW_US + 30 * DAY_US}::BIGINT AS expires_us FROM datasets""")
def dataset_append(spark, sf):
    return event_datasets(spark, sf).select(
        "id", "schema_name", "data", "seed", F.col("metadata.spec_hash").alias("spec_hash"),
        F.array_join("chaos_applied", ",").alias("faults"),
        F.unix_micros("created_at").alias("created_us"), F.unix_micros("expires_at").alias("expires_us"))


@suite.add("s7_publish", """
SELECT event_type AS topic, count(*) AS sent, 0::BIGINT AS failed, count(DISTINCT event_id//1000) AS batches
FROM events GROUP BY 1""")
def publish(spark, sf):
    df = table(spark, sf, "events")
    return P.publish(df, F.col("event_type"), "event_id", 1000, "json", work_dir(spark, "topic"))


@suite.add("s8_event_envelope", """
SELECT 'event' AS type, row_number() OVER (ORDER BY value DESC, event_id)-1 AS seq,
 '{"event_id":'||event_id||',"user_id":'||user_id||'}' AS data, 0::BIGINT AS n_faults FROM events""")
def event_envelope(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    placed = dense_position(df, [F.col("value").desc(), F.col("event_id")])
    return (envelope(placed.select("seq", "event_id", "user_id"), "seq")
            .select("type", "seq", "data", F.size("faults").cast("bigint").alias("n_faults")))


@suite.add("s9_read_items", f"""
SELECT md5(event_type||'|{SEED}|{NOW.isoformat()}|'||(seq//100)) AS id, event_id, user_id, value, props FROM (
 SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id)-1 AS seq FROM events)""")
def read_items(spark, sf):
    return DS.read_items(event_datasets(spark, sf),
                         "event_id bigint, user_id bigint, value double, props string")


# --- linking ------------------------------------------------------------------------------------

@suite.add("l1_pool_build", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_custkey IS NOT NULL")
def pool_build(spark, sf):
    return link.pool_build(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority", "not_there"])


POOL_SQL = """
pool AS (SELECT DISTINCT c_custkey, c_name, c_mktsegment FROM customer),
idx AS (SELECT *, row_number() OVER (ORDER BY md5('{"c_custkey":'||c_custkey||',"c_name":"'||c_name||
 '","c_mktsegment":"'||c_mktsegment||'"}'))-1 AS i FROM pool)"""
ORDER_SPEC = {"type": "object", "fields": {
    "order_ref": {"type": "string", "template": "ORD-{nnnnnn}", "n_type": "numeric"},
    "c_custkey": {"type": "int", "depends_on_pool": "customers"},
    "c_mktsegment": {"type": "string", "depends_on_pool": "customers"},
    "amount": {"type": "float", "min": 5, "max": 500, "precision": 2}}}


def linked_orders(spark, sf):
    pool = link.pool_build(table(spark, sf, "customer"), "c_custkey", ["c_name", "c_mktsegment"])
    return synth_over(table(spark, sf, "orders"), ORDER_SPEC, K, SEED, keep=[K],
                      pools={"customers": pool}, kind="portable")


@suite.add("l2_pool_sample", f"""WITH {POOL_SQL},
wanted AS (SELECT {K}, floor({u('pool:customers', K)}*n)::BIGINT AS i FROM orders, (SELECT count(*)::DOUBLE AS n FROM pool))
SELECT {K}, 'ORD-'||{padded('order_ref#0.0', 6)} AS order_ref, c_custkey, c_mktsegment,
 {rounded(f'{u("amount", K)}*{dbl(495)}+{dbl(5)}', 2)} AS amount FROM wanted JOIN idx USING (i)""")
def pool_sample(spark, sf):
    return linked_orders(spark, sf)


@suite.add("l3_pool_info", """WITH p AS (SELECT DISTINCT '{"o_custkey":'||o_custkey||',"o_orderpriority":"'||
 o_orderpriority||'"}' AS r FROM orders)
SELECT count(*) AS size, arg_min(r, md5(r)) AS sample FROM p""")
def pool_info(spark, sf):
    return link.pool_info(link.pool_build(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority"]))


PATIENT = {"type": "object", "fields": {
    "patient_id": {"type": "string", "template": "PAT-{nnn}", "n_type": "numeric", "pool": True},
    "first_name": {"type": "string", "string_type": "first_name", "bound_to": "patient_id"},
    "blood": {"type": "enum", "values": ["A", "B", "AB", "O"], "weights": [4, 2, 1, 3],
              "linked_to": "patient_id"},
    "visits": {"type": "int", "max": 20}}}
PID = f"'PAT-'||{padded('patient_id#0.0', 3)}"
BOUND = f"'bind|0|'||{PID}"
BLOOD = f"{u('blood', BOUND)}*{dbl(10)}"


@suite.add("l4_bind", f"""SELECT {K}, {PID} AS patient_id,
 {pick(L.FIRST_NAMES, 'first_name#first').replace('(' + K + ')', '(' + BOUND + ')')} AS first_name,
 CASE WHEN {BLOOD} <= {dbl(4)} THEN 'A' WHEN {BLOOD} <= {dbl(6)} THEN 'B' WHEN {BLOOD} <= {dbl(7)} THEN 'AB'
 ELSE 'O' END AS blood, {below('visits', K, 21)} AS visits FROM orders""")
def bind(spark, sf):
    return synth_over(table(spark, sf, "orders"), PATIENT, K, SEED, keep=[K], kind="portable")


@suite.add("l5_bind_dictionary", """
WITH known AS (SELECT c_custkey AS cust, CASE WHEN c_acctbal >= 1000 THEN c_mktsegment END AS label
               FROM customer WHERE c_acctbal > 0),
fresh AS (SELECT o_custkey AS cust, arg_min(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1)
SELECT coalesce(k.cust, f.cust) AS cust, coalesce(k.label, f.label) AS label
FROM known k FULL JOIN fresh f ON k.cust = f.cust""")
def bind_dictionary(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("cust"),
        F.when(F.col("c_acctbal") >= 1000, F.col("c_mktsegment")).alias("label"))
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("label"), "o_orderkey")
    return link.bind_dictionary(known, rows, "cust", ["label"], "o_orderkey")


@suite.add("l6_bind_cross", """
WITH dict AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS revision, c_mktsegment AS label FROM customer)
SELECT o_orderkey, o_custkey, coalesce(n.label, o_orderpriority) AS newest, coalesce(p.label, o_orderpriority) AS pinned
FROM orders LEFT JOIN dict n ON n.c_custkey = o_custkey AND n.revision = (SELECT max(revision) FROM dict)
LEFT JOIN dict p ON p.c_custkey = o_custkey AND p.revision = 1""")
def bind_cross(spark, sf):
    entries = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 5000, 2).otherwise(1).alias("revision"),
        F.col("c_mktsegment").alias("newest"), F.col("c_mktsegment").alias("pinned"))
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("newest"), F.col("o_orderpriority").alias("pinned"))
    newest = link.bind_cross(rows, entries, "o_custkey", ["newest"])
    return link.bind_cross(newest, entries, "o_custkey", ["pinned"], revision=1)


@suite.add("l7_fk_audit", """
WITH c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN -1-o_custkey WHEN '5-LOW' THEN NULL ELSE o_custkey END AS k,
  o_orderstatus AS s FROM orders)
SELECT count(*) AS rows, count_if(k IS NOT NULL AND c_custkey IS NULL) AS orphans, count_if(k IS NULL) AS null_keys,
 count_if(c_custkey IS NOT NULL AND s IS DISTINCT FROM substr(c_mktsegment, 1, 1)) AS mismatches
FROM c LEFT JOIN customer ON k = c_custkey""")
def fk_audit(spark, sf):
    key = (F.when(F.col("o_orderpriority") == "1-URGENT", -1 - F.col("o_custkey"))
           .when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")))
    child = table(spark, sf, "orders").select(key.alias("k"), F.col("o_orderstatus").alias("s"))
    parent = table(spark, sf, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 1).alias("initial"))
    return link.fk_audit(child, parent, "k", "c_custkey", {"s": "initial"})
