"""Drift operators: edited specs synthesised over the given tables, and edits of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.columns import DAY_TEXT, K, dbl, moment, over_orders, pick, rounded
from suite.common import SEED, Suite, below, bits, table, u
from synthloom.functions import lists as L
from synthloom.functions.draw import Draw
from synthloom.functions.times import to_micros
from synthloom.operators import drift as V
from synthloom.plans import drift as P

suite = Suite()
D = Draw(SEED, kind="portable")
ORDER_FIELDS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float",
                "o_orderpriority": "string"}
ORDERS = {"type": "object", "fields": ORDER_FIELDS}
COLS = list(ORDER_FIELDS)


def draw_sql(seed: int, *place: object) -> str:
    """The draw of a place of a drift plan, computed by the SQL side itself."""
    text = "|".join(map(str, (seed, *place)))
    return f"(('0x'||substr(md5('{text}'),1,13))::BIGINT/4503599627370496.0::DOUBLE)"


def inside_sql(lo: float, hi: float, seed: int, *place: object) -> str:
    return f"({dbl(float(lo))}+{draw_sql(seed, *place)}*{dbl(float(hi) - float(lo))})"


# One template only, so that the SQL can say what a new field holds; its name is all that is read from the plan.
ADDED = P.plan_structure(ORDERS, 11, ("add",), 3, templates={"count": {"type": "int", "min": 20, "max": 59}})
NEW = {e.path[0]: e.value for e in ADDED}


@suite.add("v1_add_field", f"SELECT {', '.join(COLS)}, {', '.join(f'20+{below(k, K, 40)} AS {k}' for k in NEW)} FROM orders")
def add_field(spark, sf):
    df = table(spark, sf, "orders").select(*COLS)
    for name, node in NEW.items():
        df = V.add_field(df, name, node, D, K)
    return df


DROPPED = [e.path[0] for e in P.plan_structure(ORDERS, 3, ("drop",), 2, keep=(K,))]
LEFT = [c for c in COLS if c not in DROPPED]


@suite.add("v2_drop_field", f"SELECT {', '.join(LEFT)}, strftime(o_orderdate, '%Y') AS year FROM orders")
def drop_field(spark, sf):
    day = F.struct(F.date_format("o_orderdate", "yyyy").alias("year"), F.col("o_orderdate").alias("full"))
    df = table(spark, sf, "orders").withColumn("day", day).select(*COLS, "day")
    for name in DROPPED:
        df = V.drop_field(df, name)
    return V.drop_field(df, "day.full").select(*LEFT, "day.year")


RENAME = P.plan_structure(ORDERS, 5, ("rename",), keep=(K,))[0]
OLD, NEWNAME = RENAME.path[0], RENAME.value


@suite.add("v3_rename_field", f"SELECT {', '.join(c for c in COLS if c != OLD)}, {OLD} AS {NEWNAME} FROM orders")
def rename_field(spark, sf):
    return V.rename_field(table(spark, sf, "orders").select(*COLS), OLD, NEWNAME)


@suite.add("v4_flatten_object", "SELECT event_id, user_id AS who_id, event_type AS who_did FROM events")
def flatten_object(spark, sf):
    who = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("did"))
    return V.flatten_object(table(spark, sf, "events").select("event_id", who.alias("who")), "who")


NUM = {"type": "object", "fields": {"qty": {"type": "int", "min": 1, "max": 100, "step": 3},
                                    "price": {"type": "float", "min": 5, "max": 500, "precision": 2}}}
NUM2 = P.apply_edits(NUM, P.plan_values(NUM, 1, {"int": {"shift": (10, 40), "step": (-2, 2)}, "float": {"share": (-0.4, 0.4)}}))
_BY, _STEP = f"round_even({inside_sql(10, 40, 1, 'qty', 'shift')}, 0)", f"greatest(1, 3+round_even({inside_sql(-2, 2, 1, 'qty', 'step')}, 0))"
_PRICE = f"{u('price', K)}*495.0::DOUBLE+(5.0::DOUBLE+495.0::DOUBLE*{inside_sql(-0.4, 0.4, 1, 'price', 'shift')})"


@suite.add("v5_drift_numeric", f"""WITH m AS (SELECT {_BY}::BIGINT AS d, {_STEP}::BIGINT AS s)
SELECT {K}, 1+d+floor({u('qty', K)}*(99//s+1)::DOUBLE)::BIGINT*s AS qty, {rounded(_PRICE, 2)} AS price, o_custkey+17 AS shifted FROM orders, m""")
def drift_numeric(spark, sf):
    made = over_orders(spark, sf, NUM2["fields"])
    moved = V.shift_numeric(table(spark, sf, "orders").select(K, F.col("o_custkey").alias("shifted")), "shifted", 17)
    return made.join(moved, K)


TIME = {"type": "object", "fields": {"at": {"type": "timestamp", "start": "2024-01-01T00:00:00+00:00", "end": "2026-01-01T00:00:00+00:00"},
                                     "day": DAY_TEXT}}
TIME2 = P.apply_edits(TIME, P.plan_values(TIME, 2, {"timestamp": {"shift": (-86400, 86400)}, "datetime": {"share": (-0.2, 0.2)}}))
_FROM, _TO = (to_micros(TIME["fields"]["at"][k]) for k in ("start", "end"))
_DAYS = [to_micros(DAY_TEXT[k]) for k in ("start", "end")]


def moved_sql(path: str, lo: int, hi: int, seconds: str) -> str:
    """The moment drawn from a window that has moved; moving both ends moves the moment."""
    return f"({moment(path, lo, hi)}+round_even({seconds}*1000000::DOUBLE, 0)::BIGINT)"


@suite.add("v6_drift_time", f"""SELECT {K}, {moved_sql('at', _FROM, _TO, inside_sql(-86400, 86400, 2, 'at', 'shift'))} AS at_us,
 strftime(make_timestamp({moved_sql('day', *_DAYS, f"({dbl((_DAYS[1] - _DAYS[0]) / 1e6)}*{inside_sql(-0.2, 0.2, 2, 'day', 'shift')})")}), '%Y%m%d') AS day,
 epoch_us(o_orderdate)-3600000000 AS moved_us FROM orders""")
def drift_time(spark, sf):
    made = over_orders(spark, sf, TIME2["fields"]).withColumnRenamed("at", "at_us")
    moved = V.shift_time(table(spark, sf, "orders").select(K, "o_orderdate"), "o_orderdate", -3600)
    return made.join(moved.select(K, F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("moved_us")), K)


WEIGHTS = {"type": "object", "fields": {
    "tier": {"type": "enum", "values": ["free", "pro", "enterprise"], "weights": [60, 30, 10]},
    "one": {"type": "one_of", "weights": [1, 3], "choices": [{"type": "string", "template": "a"}, {"type": "string", "template": "b"}]}}}
MOVED = P.apply_edits(WEIGHTS, P.plan_values(WEIGHTS, 4, {"enum": {"order": False, "only": True}, "one_of": {"move": (0.1, 0.2)}}))
SHUFFLED = P.apply_edits(WEIGHTS, P.plan_values(WEIGHTS, 4, {"enum": {"move": (0.0, 0.0)}}, fields=["tier"]))
_ONE = inside_sql(0.1, 0.2, 4, "one", "move")  # goes to one of the two choices, from the other
_A_SHARE = f"round(CASE WHEN {draw_sql(4, 'one', 'to')} < 0.5 THEN 0.25+{_ONE} ELSE 0.25-{_ONE} END, 4)"


@suite.add("v7_drift_weights", f"""
WITH o AS (SELECT v, w, row_number() OVER (ORDER BY d) AS r FROM (VALUES ('free', 0.6, {draw_sql(4, 'tier', 'order', 0)}),
 ('pro', 0.3, {draw_sql(4, 'tier', 'order', 1)}), ('enterprise', 0.1, {draw_sql(4, 'tier', 'order', 2)})) t(v, w, d)),
c AS (SELECT list(v ORDER BY r) AS v, list(w ORDER BY r) AS w FROM o)
SELECT {K}, ['free','pro','enterprise'][1+floor({draw_sql(4, 'tier', 'to')}*3)::BIGINT] AS tier,
 CASE WHEN {u('tier', K)} <= w[1] THEN v[1] WHEN {u('tier', K)} <= w[1]+w[2] THEN v[2] ELSE v[3] END AS shuffled,
 CASE WHEN {u('one#pick', K)} <= {_A_SHARE} THEN 'a' ELSE 'b' END AS one FROM orders, c""")
def drift_weights(spark, sf):
    shuffled = over_orders(spark, sf, {"tier": SHUFFLED["fields"]["tier"]}).withColumnRenamed("tier", "shuffled")
    return over_orders(spark, sf, MOVED["fields"]).join(shuffled, K)


NULLS = {"type": "object", "fields": {"n": {"type": "int", "min": 0, "max": 9},
                                      "m": {"type": "maybe", "p_null": 0.4, "child": "bool"}}}
NULLS2 = P.apply_edits(NULLS, P.plan_values(NULLS, 6, {"int": {"shift": (3, 3), "nulls": (0.2, 0.6)}, "maybe": {"move": (-0.3, -0.1)}}))


@suite.add("v8_drift_nulls", f"""SELECT {K}, CASE WHEN {u('n#null', K)} >= {inside_sql(0.2, 0.6, 6, 'n', 'nulls')} THEN 3+{below('n.?', K, 10)} END AS n,
 CASE WHEN {u('m#null', K)} >= 0.4::DOUBLE+{inside_sql(-0.3, -0.1, 6, 'm', 'null')} THEN {u('m.?', K)} < 0.5 END AS m,
 CASE WHEN {u('o_custkey#drift_null', K)} >= {dbl(.25)} THEN o_custkey END AS thinned FROM orders""")
def drift_nulls(spark, sf):
    thin = V.shift_nulls(table(spark, sf, "orders").select(K, "o_custkey"), "o_custkey", 0.25, D, K)
    return over_orders(spark, sf, NULLS2["fields"]).join(thin.withColumnRenamed("o_custkey", "thinned"), K)


SHAPE = {"type": "object", "fields": {"tags": {"type": "array", "min_items": 2, "max_items": 6, "child": "bool"}}}
SHAPE2 = P.apply_edits(SHAPE, P.plan_values(SHAPE, 8, {"array": {"move": (1, 3)}}))


@suite.add("v9_drift_shape", f"SELECT {K}, 2+round_even({inside_sql(1, 3, 8, 'tags', 'length')}, 0)::BIGINT+{below('tags#size', K, 5)} AS size FROM orders")
def drift_shape(spark, sf):
    return over_orders(spark, sf, SHAPE2["fields"]).select(K, F.size("tags").cast("bigint").alias("size"))


LAYERED = {"base": {"type": "object", "fields": {"qty": {"type": "int", "min": 1, "max": 10}, "name": {"type": "string", "string_type": "word"}}},
           "v1": {"type": "object", "fields": {"qty": {"type": "int", "min": 101, "max": 110}, "name": {"type": "string", "string_type": "word"},
                                               "extra": "bool"}},
           "v2": {"type": "object", "fields": {"qty": {"type": "int", "min": 1001, "max": 1010}}}}


def revisions() -> list[tuple[int, int, str]]:
    wanted = [P.Layer(1000, "v1", "structure", 3000), P.Layer(2500, "v2", "values", 500),
              P.Layer(2600, "v3", "values")]  # the third is refused: two layers at most
    return P.intervals(P.accept(wanted, most=2), 10**15)


@suite.add("v10_drift_layers", f"""
WITH l AS (SELECT {K}, CASE WHEN {K} < 1000 THEN 'base' WHEN {K} < 2500 THEN 'v1' WHEN {K} < 3000 THEN 'v2' WHEN {K} < 4500 THEN 'v1' ELSE 'base' END AS version FROM orders)
SELECT {K}, version, CASE version WHEN 'base' THEN 1 WHEN 'v1' THEN 101 ELSE 1001 END+{below('qty', K, 10)} AS qty,
 CASE WHEN version <> 'v2' THEN {pick(L.WORDS, 'name#word')} END AS name, CASE WHEN version = 'v1' THEN {u('extra', K)} < {dbl(.5)} END AS extra FROM l""")
def drift_layers(spark, sf):
    df = V.synth_layers(table(spark, sf, "orders"), LAYERED, revisions(), K, SEED, keep=[K], kind="portable")
    return df.withColumnRenamed("_version", "version")


@suite.add("v10_version_of_row", f"""
SELECT {K}, CASE WHEN {K} < 1000 THEN 'base' WHEN {K} < 2500 THEN 'v1' WHEN {K} < 3000 THEN 'v2' WHEN {K} < 4500 THEN 'v1' ELSE 'base' END AS version FROM orders""")
def version_of_row(spark, sf):
    return table(spark, sf, "orders").select(K, V.version_of(F.col(K), revisions()).alias("version"))


@suite.add("v11_schema_diff", """
SELECT * FROM (VALUES ('new','added',NULL,'bool',NULL), ('props','dropped','object',NULL,NULL), ('props_k','flattened',NULL,'int','props.k'),
 ('v','retyped','string','float',NULL)) t(path, change, old_type, new_type, moved_from)
WHERE (SELECT count(DISTINCT event_type) FROM events) > 1""")
def schema_diff(spark, sf):
    ev = table(spark, sf, "events")
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    before = ev.select("event_id", F.concat(F.lit('{"id":'), "event_id", F.lit(',"v":"'), amount, F.lit('","props":'), "props", F.lit("}")).alias("doc"))
    after = ev.select("event_id", F.concat(F.lit('{"id":'), "event_id", F.lit(',"v":'), amount, F.lit(',"new":true,"props_k":'),
                                           F.get_json_object("props", "$.k"), F.lit("}")).alias("doc"))
    return V.schema_diff(V.json_paths(before, "doc", "event_id"), V.json_paths(after, "doc", "event_id"))


_SIDES = """old AS (SELECT unnest([{'p': 'user', 'k': 'number', 'x': user_id::VARCHAR}, {'p': 'kind', 'k': 'string', 'x': event_type},
  {'p': 'gone', 'k': 'number', 'x': (event_id + 10000000)::VARCHAR}]) AS s FROM events),
new AS (SELECT unnest([{'p': 'member', 'k': 'number', 'x': user_id::VARCHAR}, {'p': 'kind_of', 'k': 'string', 'x': event_type},
  {'p': 'copy_of', 'k': 'string', 'x': CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END}]) AS s FROM events)"""


def _cells(side: str) -> str:
    h = bits("sketch", "s.x")
    return f"SELECT s.p AS p, s.k AS k, {h} % 64 AS c, min({h}) AS least FROM {side} GROUP BY 1, 2, 3"


@suite.add("v11_renames", f"""
WITH {_SIDES}, a AS ({_cells('old')}), b AS ({_cells('new')}),
m AS (SELECT a.p AS o, b.p AS n, any_value(a.k) AS k, count(*)::DOUBLE/greatest((SELECT count(*) FROM a x WHERE x.p = a.p), (SELECT count(*) FROM b x WHERE x.p = b.p)) AS ratio
  FROM a JOIN b ON a.k = b.k AND a.c = b.c AND a.least = b.least GROUP BY a.p, b.p),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY ratio DESC, n) AS i, row_number() OVER (PARTITION BY n ORDER BY ratio DESC, o) AS j FROM m WHERE ratio >= 0.5),
t AS (SELECT n AS path, 'renamed' AS change, CASE k WHEN 'number' THEN 'int' ELSE k END AS old_type, CASE k WHEN 'number' THEN 'int' ELSE k END AS new_type, o AS moved_from, ratio
  FROM r WHERE i = 1 AND j = 1)
SELECT * FROM t UNION ALL SELECT 'copy_of', 'added', NULL, 'string', NULL, NULL WHERE 'copy_of' NOT IN (SELECT path FROM t)
UNION ALL SELECT 'gone', 'dropped', 'int', NULL, NULL, NULL WHERE 'gone' NOT IN (SELECT moved_from FROM t)""")
def renames(spark, sf):
    ev = table(spark, sf, "events")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    before = ev.select("event_id", F.concat(F.lit('{"id":'), "event_id", F.lit(',"user":'), "user_id", F.lit(',"kind":'), quoted(F.col("event_type")),
                                            F.lit(',"gone":'), (F.col("event_id") + 10_000_000).cast("string"), F.lit("}")).alias("doc"))
    other = F.when(F.col("event_type") == "click", "tap").otherwise(F.col("event_type"))
    after = ev.select("event_id", F.concat(F.lit('{"id":'), "event_id", F.lit(',"member":'), "user_id", F.lit(',"kind_of":'), quoted(F.col("event_type")),
                                           F.lit(',"copy_of":'), quoted(other), F.lit("}")).alias("doc"))
    return V.schema_diff_rows(before, after, "doc", "event_id", Draw(SEED, kind="portable"))
