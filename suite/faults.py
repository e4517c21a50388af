"""Fault operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.columns import dbl
from suite.common import SEED, Suite, below, digest, strings, table, text, u
from synthloom.functions import lists as L
from synthloom.functions import text as TX
from synthloom.functions.draw import Draw
from synthloom.operators import audit, faults as X, json_faults as J
from synthloom.plans.fault_plan import FaultOp, FaultPlan, apply_plan

suite = Suite()
E = "event_id"
D = Draw(SEED, kind="portable")


def hit(op: str, p: float, key: str = E) -> str:
    return f"({u(op + '#hit', key)} < {dbl(p)})"


def events(spark, sf, *cols):
    df = table(spark, sf, "events")
    return df.select(*cols) if cols else df



def tags(df, *cols):
    return df.select(*cols, F.array_join("_faults", ";").alias("faults"))


# --- rows ---------------------------------------------------------------------------------------

@suite.add("f1_duplicate_rows", f"""
WITH n AS (SELECT *, CASE WHEN {hit('duplicate_rows', .1)} THEN {below('duplicate_rows#n', E, 3)}+1 ELSE 0 END AS times FROM events),
c AS (SELECT *, unnest(range(0, times+1)) AS copy FROM n)
SELECT event_id, value, copy, {digest('duplicate_rows#at', E)} AS ord,
 CASE WHEN copy > 0 THEN 'duplicate_rows('||copy||')' ELSE '' END AS faults FROM c""")
def duplicate_rows(spark, sf):
    df = X.duplicate_rows(events(spark, sf), D, E, p=0.1, max_dups=3)
    return tags(df, E, "value", F.col("_copy").alias("copy"), F.col("_ord").alias("ord"))


@suite.add("f1_duplicate_rows_in_batch", f"""
WITH pick AS (SELECT event_id FROM events QUALIFY row_number() OVER (
  PARTITION BY user_id ORDER BY {digest('duplicate_rows#pick', E)}) <= 2)
SELECT event_id, user_id, 0::BIGINT AS copy FROM events
UNION ALL SELECT event_id, user_id, 1 FROM events SEMI JOIN pick USING (event_id)""")
def duplicate_rows_in_batch(spark, sf):
    df = X.duplicate_rows_in_batch(events(spark, sf), D, E, "user_id", max_dups=2)
    return df.select(E, "user_id", F.col("_copy").alias("copy"))


EMB = "vec_id"
_DUP = "duplicate_elements:embedding#pick"


@suite.add("f2_duplicate_elements", f"""
WITH v AS (SELECT vec_id, embedding AS e, len(embedding) AS n FROM embeddings),
p AS (SELECT *, list_transform(range(1, least(n,2)+1), lambda d: {below(_DUP, f"{EMB}||'|'||d", 'n')}) AS spots FROM v)
SELECT vec_id, len(out) AS n, array_to_string(list_transform(out, lambda x: (x::DOUBLE*1e6)::BIGINT), ',') AS vals FROM (
 SELECT vec_id, flatten(list_transform(range(0, n), lambda i: list_transform(
  range(0, 1+len(list_filter(spots, lambda a: a = i))), lambda r: e[i+1]))) AS out FROM p)""")
def duplicate_elements(spark, sf):
    df = X.duplicate_elements(table(spark, sf, "embeddings"), D, EMB, max_dups=2)
    return df.select(EMB, F.size("embedding").cast("bigint").alias("n"), vector_text("embedding"))


def vector_text(col):
    scaled = F.transform(col, lambda x: F.rint(x.cast("double") * F.lit(1e6)).cast("bigint").cast("string"))
    return F.array_join(scaled, ",").alias("vals")


@suite.add("f3_shuffle_rows", f"""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('{SEED}|shuffle_rows|'||conv_id||'-'||turn))-1 AS ord
FROM conversations""")
def shuffle_rows(spark, sf):
    df = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("key"))
    return X.shuffle_rows(df, D, "key", "conv_id").select("conv_id", "turn", "ord")


@suite.add("f3_shuffle_whole_table", f"""
SELECT event_id, row_number() OVER (ORDER BY {digest('shuffle_rows', E)})-1 AS ord FROM events""")
def shuffle_whole_table(spark, sf):
    return X.shuffle_rows(events(spark, sf, E), D, E).select(E, "ord")


@suite.add("f4_shuffle_arrays", f"""
SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(0, len(embedding)), lambda i:
 {{'h': {digest('shuffle_arrays:embedding', f"{EMB}||'|'||i")}, 'i': i}})), lambda s: (embedding[s.i+1]::DOUBLE*1e6)::BIGINT), ',') AS vals
FROM embeddings""")
def shuffle_arrays(spark, sf):
    return X.shuffle_arrays(table(spark, sf, "embeddings"), D, EMB).select(EMB, vector_text("embedding"))


# --- keys and nulls -----------------------------------------------------------------------------

def lost(names: list[str], op: str, key: str) -> str:
    """SQL list of names sorted by their draw, cut to the drawn number."""
    pairs = ", ".join(f"{{'h': {digest(f'{op}#{n}', key)}, 'f': '{n}'}}" for n in names)
    k = f"(1+{below(op + '#n', key, min(3, len(names)))})"
    return f"list_sort(list_transform(list_sort([{pairs}])[1:{k}], lambda s: s.f))"


@suite.add("f5_partial_load", f"""
WITH m AS (SELECT *, CASE WHEN {hit('partial_load', .2)} THEN {lost(['user_id', 'event_type', 'value'], 'partial_load', E)}
  ELSE [] END AS gone FROM events)
SELECT event_id, CASE WHEN NOT list_contains(gone, 'user_id') THEN user_id END AS user_id,
 CASE WHEN NOT list_contains(gone, 'event_type') THEN event_type END AS event_type,
 CASE WHEN NOT list_contains(gone, 'value') THEN value END AS value, array_to_string(gone, ',') AS missing FROM m""")
def partial_load(spark, sf):
    df = X.partial_load(events(spark, sf, E, "user_id", "event_type", "value"), D, E, p=0.2)
    return df.select(E, "user_id", "event_type", "value", F.array_join("_missing", ",").alias("missing"))


@suite.add("f5_partial_load_json", f"""
SELECT event_id, CASE WHEN {hit('partial_load', .2)} THEN '{{}}' ELSE replace(props, ' ', '') END AS props,
 CASE WHEN {hit('partial_load', .2)} THEN 'k' ELSE '' END AS missing FROM events""")
def partial_load_json(spark, sf):
    df = J.partial_load_json(events(spark, sf, E, "props"), D, E, "props", p=0.2)
    return df.select(E, F.replace("props", F.lit(" "), F.lit("")).alias("props"), F.array_join("_missing", ",").alias("missing"))


def offer(names: list[str], op: str, key: str) -> str:
    cells = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN {{'h': {digest(f'{op}#{n}', key)}, 'f': '{n}'}} END" for n in names)
    return f"list_min(list_filter([{cells}], lambda s: s IS NOT NULL))"


@suite.add("f6_null_field", f"""
WITH o AS (SELECT *, CASE WHEN {hit('null_field', .3)} THEN {offer(['event_type', 'value'], 'null_field', E)}.f END AS f FROM events)
SELECT event_id, CASE WHEN f IS DISTINCT FROM 'event_type' THEN event_type END AS event_type,
 CASE WHEN f IS DISTINCT FROM 'value' THEN value END AS value, coalesce('null_field('||f||')', '') AS faults FROM o""")
def null_field(spark, sf):
    return tags(X.null_field(events(spark, sf), D, E, fields=["event_type", "value"], p=0.3), E, "event_type", "value")


@suite.add("f6_null_field_in_batch", f"""
WITH o AS (SELECT *, {offer(['event_type', 'value'], 'null_field', E)} AS o FROM events),
b AS (SELECT user_id, min(o.h) AS h FROM o GROUP BY 1)
SELECT event_id, user_id, CASE WHEN NOT (o.h = b.h AND o.f = 'event_type') THEN event_type END AS event_type,
 CASE WHEN NOT (o.h = b.h AND o.f = 'value') THEN value END AS value FROM o JOIN b USING (user_id)""")
def null_field_in_batch(spark, sf):
    df = X.null_field(events(spark, sf), D, E, fields=["event_type", "value"], per="batch", batch="user_id")
    return df.select(E, "user_id", "event_type", "value")


@suite.add("f6_null_nested", f"""
WITH o AS (SELECT event_id, user_id, value, CASE WHEN {hit('null_field', .5)} THEN
 list_min([{{'h': {digest('null_field#s.a', E)}, 'f': 's.a'}}, {{'h': {digest('null_field#arr[].v', E)}, 'f': 'arr[].v'}}]).f END AS f,
 {below('null_field#arr[].v@', E, 2)} AS i FROM events)
SELECT event_id, CASE WHEN f IS DISTINCT FROM 's.a' THEN user_id END AS a,
 CASE WHEN NOT (f IS NOT DISTINCT FROM 'arr[].v' AND i = 0) THEN value END AS v0,
 CASE WHEN NOT (f IS NOT DISTINCT FROM 'arr[].v' AND i = 1) THEN value+1 END AS v1 FROM o""")
def null_nested(spark, sf):
    df = events(spark, sf).select(
        E, F.struct(F.col("user_id").alias("a"), "event_type").alias("s"),
        F.array(F.struct(F.col("value").alias("v")), F.struct((F.col("value") + 1).alias("v"))).alias("arr"))
    df = X.null_field(df, D, E, fields=["s.a", "arr[].v"], p=0.5)
    return df.select(E, F.col("s.a").alias("a"), F.col("arr")[0]["v"].alias("v0"), F.col("arr")[1]["v"].alias("v1"))


# --- text ---------------------------------------------------------------------------------------

DOC = "doc_id"
_ROOT = """'{"doc_id":'||doc_id||',"lang":'||to_json(lang)||',"text":'||to_json(text)||'}'"""


def cut(s: str, key: str) -> str:
    keep = f"CASE WHEN length({s}) <= 1 THEN 1 ELSE floor({u('truncate_json#at', key)}*(length({s})-1)::DOUBLE)::BIGINT+1 END"
    return f"substr({s}, 1, {keep})"


@suite.add("f7_truncate_json", f"""
WITH d AS (SELECT doc_id, lang, text, {_ROOT} AS root, to_json(text)::VARCHAR AS jt, CASE WHEN {hit('truncate_json', .3, DOC)} THEN
 {below('truncate_json#node', DOC, 2)} END AS node FROM documents)
SELECT doc_id, CASE WHEN node IS NULL OR node = 1 THEN lang END AS lang,
 CASE WHEN node IS NULL THEN text WHEN node = 1 THEN {cut('jt', DOC)} END AS text,
 CASE WHEN node = 0 THEN {cut('root', DOC)} END AS corrupt FROM d""")
def truncate_json(spark, sf):
    df = table(spark, sf, "documents").select(DOC, "lang", "text")
    df = X.truncate_json(df, D, DOC, p=0.3, nodes=["", "text"], unit="chars")
    return df.select(DOC, "lang", "text", F.col("_corrupt_record").alias("corrupt"))


_WHOLE = "'{\"doc_id\":'||doc_id||','||" + "||','||".join(
    f"'\"{c}\":'||coalesce(to_json({c})::VARCHAR, 'null')" for c in ("text", "lang", "source", "n_chars")) + "||'}'"
# the last character of a cut text, where bytes of it are missing: one, two or three bytes of a longer one
_BROKEN = "(?:[C-F].|[EF].[89AB].|F.[89AB].[89AB].)$"


@suite.add("f7_truncate_json_bytes", f"""
WITH d AS (SELECT *, {_WHOLE} AS root, CASE WHEN {hit('truncate_json', .3, DOC)} THEN {below('truncate_json#node', DOC, 5)} END AS node,
 {u('truncate_json#at', DOC)} AS ua FROM documents),
r AS (SELECT *, CASE node WHEN 0 THEN root WHEN 1 THEN to_json(text)::VARCHAR WHEN 2 THEN to_json(lang)::VARCHAR ELSE 'xx' END AS raw FROM d),
c AS (SELECT *, decode(unhex(regexp_replace(substr(hex(encode(raw)), 1, 2*(floor(ua*(strlen(raw)-1)::DOUBLE)::BIGINT+1)), '{_BROKEN}', ''))) AS part FROM r)
SELECT doc_id, CASE WHEN node = 2 THEN part WHEN node = 0 THEN NULL ELSE lang END AS lang, CASE WHEN node IN (0, 4) THEN NULL ELSE n_chars END AS n_chars,
 length(CASE WHEN node = 1 THEN part WHEN node = 0 THEN NULL ELSE text END) AS size, CASE WHEN node = 0 THEN md5(part) END AS corrupt,
 CASE WHEN node = 4 AND n_chars IS NOT NULL THEN '[n_chars]' ELSE '[]' END AS fragments FROM c""")
def truncate_json_bytes(spark, sf):
    df = X.truncate_json(table(spark, sf, "documents"), D, DOC, p=0.3, unit="bytes")
    return df.select(DOC, "lang", "n_chars", F.length("text").alias("size"), F.md5("_corrupt_record").alias("corrupt"),
                     F.map_keys("_fragments").cast("string").alias("fragments"))


_SPREAD = "".join(chr(32 + (37 * i + 5) % 95) for i in range(16))


@suite.add("f8_bloat", f"""
WITH d AS (SELECT doc_id, text, {hit('bloat', .2, DOC)} AS h, {u('bloat#at', DOC)} AS ua FROM documents),
p AS (SELECT *, substr(array_to_string(list_transform(range(0, 64), lambda j:
  translate({digest('bloat#pad', f"{DOC}||'|'||j")}, '0123456789abcdef', {text(_SPREAD)})), ''), 1, 2048) AS pad,
  floor(ua*(length(text)+1)::DOUBLE)::BIGINT AS pos FROM d)
SELECT doc_id, CASE WHEN h THEN substr(text,1,pos)||pad||substr(text,pos+1) ELSE text END AS text,
 CASE WHEN h THEN 'bloat(text,+2048 insert)' ELSE '' END AS faults FROM p""")
def bloat(spark, sf):
    df = table(spark, sf, "documents").select(DOC, "text")
    return tags(X.bloat(df, D, DOC, p=0.2, extra_kb=2), DOC, "text")


@suite.add("f8_bloat_repeat", f"""
WITH d AS (SELECT p_partkey, p_name, {hit('bloat', .5, 'p_partkey')} AS h, regexp_extract(p_name, '(\\S+)\\s*$', 1) AS w FROM part),
r AS (SELECT *, repeat(w||' ', ceil(1024.0::DOUBLE/(length(w)+1))::INT) AS more FROM d)
SELECT p_partkey, CASE WHEN h THEN p_name||substr(more, 1, 1024) ELSE p_name END AS p_name FROM r""")
def bloat_repeat(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    return X.bloat(df, D, "p_partkey", p=0.5, extra_kb=1, strategy="repeat").select("p_partkey", "p_name")


def corrupted(s: str, how: str, up: str, uc: str) -> str:
    """SQL twin of the nine strategies, with their fallbacks."""
    n = f"length({s})"

    def at(count: str) -> str:
        return f"floor({up}*({count})::DOUBLE)::BIGINT"

    def ch(chars: str) -> str:
        return f"substr({text(chars)}, floor({uc}*{len(chars)}::DOUBLE)::BIGINT+1, 1)"

    def put(pos: str, drop: int, new: str) -> str:
        return f"substr({s},1,{pos})||{new}||substr({s},{pos}+{1 + drop})"

    def alike(alphabet: str, target: str, fallback: str) -> str:
        parts = f"string_split_regex({s}, '[{alphabet}]')"
        hits = f"(len({parts})-1)"
        pos = f"length(array_to_string({parts}[1:floor({up}*{hits}::DOUBLE)::BIGINT+1], 'x'))"
        return (f"CASE WHEN {hits} > 0 THEN substr({s},1,{pos})||translate(substr({s},{pos}+1,1), "
                f"'{alphabet}', {text(target)})||substr({s},{pos}+2) ELSE {fallback} END")

    rep, zero = put(at(n), 1, text(L.REPLACEMENT)), put(at(n + "+1"), 0, ch(L.ZERO_WIDTH))
    sw = at(n + "-1")
    a, b = f"substr({s},{sw}+1,1)", f"substr({s},{sw}+2,1)"
    return f"""CASE WHEN {s} IS NULL OR {n} = 0 THEN {s} WHEN {how} = 0 THEN {rep}
 WHEN {how} = 1 AND {n} > 1 THEN {put(at(n), 1, "''")}
 WHEN {how} = 2 AND {n} > 1 AND {a} <> {b} THEN {put(sw, 2, f'{b}||{a}')}
 WHEN {how} = 3 THEN {zero} WHEN {how} = 4 THEN {alike(L.HOMOGLYPH_FROM, L.HOMOGLYPH_TO, rep)}
 WHEN {how} = 5 THEN {alike(L.ASCII_ALNUM, L.FULLWIDTH_ALNUM, zero)}
 WHEN {how} = 6 THEN {s}||{ch(L.FULLWIDTH_DIGITS)} WHEN {how} = 7 THEN {put(at(n + '+1'), 0, ch(L.CONFUSABLE))}
 ELSE {put(at(n), 0, ch(L.COMBINING))} END"""


STRATS = strings(TX.STRATEGIES)


@suite.add("f9_corrupt_text", f"""
WITH d AS (SELECT doc_id, text, {hit('corrupt_text', .5, DOC)} AND length(text) > 0 AS h, {below('corrupt_text#how', DOC, 9)} AS how,
 {u('corrupt_text#pos', DOC)} AS up, {u('corrupt_text#chr', DOC)} AS uc FROM documents)
SELECT doc_id, CASE WHEN h THEN {corrupted('text', 'how', 'up', 'uc')} ELSE text END AS text,
 CASE WHEN h THEN 'corrupt_text(text '||{STRATS}[how+1]||')' ELSE '' END AS faults FROM d""")
def corrupt_text(spark, sf):
    df = table(spark, sf, "documents").select(DOC, "text")
    return tags(X.corrupt_text(df, D, DOC, p=0.5), DOC, "text")


@suite.add("f9_corrupt_short_text", f"""
WITH d AS (SELECT o_orderkey, o_orderstatus AS s, {below('corrupt_text#how', 'o_orderkey', 9)} AS how,
 {u('corrupt_text#pos', 'o_orderkey')} AS up, {u('corrupt_text#chr', 'o_orderkey')} AS uc FROM orders)
SELECT o_orderkey, {corrupted('s', 'how', 'up', 'uc')} AS s FROM d""")
def corrupt_short_text(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return X.corrupt_text(df, D, "o_orderkey", p=1.0).select("o_orderkey", "s")


_KEY = f"{E}||'|1'"  # the key is the second token
_NEWKEY = corrupted("key", "how", "up", "uc")


@suite.add("f10_corrupt_key", f"""
WITH d AS (SELECT event_id, props, 'k' AS key, {hit('corrupt_key', .4)} AS h, {below('corrupt_key#how', _KEY, 9)} AS how,
 {u('corrupt_key#pos', _KEY)} AS up, {u('corrupt_key#chr', _KEY)} AS uc FROM events)
SELECT event_id, CASE WHEN h THEN '{{"'||{_NEWKEY}||'": '||(props->>'$.k')||'}}' ELSE props END AS props FROM d""")
def corrupt_key(spark, sf):
    return J.corrupt_key(events(spark, sf, E, "props"), D, E, "props", p=0.4).select(E, "props")


# --- time ---------------------------------------------------------------------------------------

def sign(op: str, f: str, key: str) -> str:
    return f"CASE WHEN {u(f'{op}#sign:{f}', key)} < {dbl(.5)} THEN -1 ELSE 1 END"


@suite.add("f11_time_skew", f"""
SELECT event_id, us + CASE WHEN {hit('time_skew', .5)} THEN {below('time_skew#us', E, 301)}*{sign('time_skew', 'us', E)} ELSE 0 END AS us,
 CASE WHEN {hit('time_skew', .5)} THEN 'time_skew(us)' ELSE '' END AS faults FROM (SELECT event_id, epoch_us(ts) AS us FROM events)""")
def time_skew(spark, sf):
    df = events(spark, sf, E, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return tags(X.time_skew(df, D, E, ["us"], max_skew_s=300, p=0.5), E, "us")


_SK = {f: f"{below(f'time_skew_typed#{f}', E, 300)}*1000000*{sign('time_skew_typed', f, E)}" for f in ("us", "secs", "iso", "ts")}


@suite.add("f12_time_skew_typed", f"""
WITH d AS (SELECT event_id, ts, epoch_us(ts) AS us, epoch_us(ts)//1000000 AS secs FROM events)
SELECT event_id, us+{_SK['us']} AS us, (secs*1000000+{_SK['secs']})//1000000 AS secs,
 strftime(make_timestamp(secs*1000000+{_SK['iso']}), '%Y-%m-%dT%H:%M:%S')||'Z' AS iso, us+{_SK['ts']} AS ts_us FROM d""")
def time_skew_typed(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    df = events(spark, sf, E, "ts", us.alias("us"), F.floor(us / 1_000_000).alias("secs"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    df = X.time_skew_typed(df, D, E, ["us", "secs", "iso", "ts"], max_skew_s=300)
    return df.select(E, "us", "secs", "iso", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@suite.add("f13_late_arrival", f"""
WITH r AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
d AS (SELECT event_id, epoch_us(ts) AS us, b, least(7200000000, b-a) AS w FROM events, r)
SELECT event_id, CASE WHEN {hit('late_arrival', .1)} THEN b-w+floor({u('late_arrival#at', E)}*(w+1)::DOUBLE)::BIGINT ELSE us END AS us,
 CASE WHEN {hit('late_arrival', .1)} THEN 'late_arrival(ts)' ELSE '' END AS faults FROM d""")
def late_arrival(spark, sf):
    df = X.late_arrival(events(spark, sf), D, E, "ts", late_window_seconds=7200, p=0.1)
    return tags(df, E, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@suite.add("f14_detect_time_columns", """
SELECT * FROM (VALUES ('ts', 'timestamp', 1.0::DOUBLE), ('iso', 'iso', 1.0::DOUBLE), ('us', 'epoch_micro', 1.0::DOUBLE)) t("column", encoding, share)
WHERE (SELECT bool_and(ts BETWEEN TIMESTAMP '1990-01-01' AND TIMESTAMP '2100-01-01') FROM events)""")
def detect_time_columns(spark, sf):
    df = events(spark, sf).withColumns({
        "iso": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "us": F.unix_micros(F.col("ts").cast("timestamp"))})
    return X.time_columns(df)


# --- plan and audit -----------------------------------------------------------------------------

PLAN = FaultPlan(ops=(
    FaultOp("null_field", 0.5, 2.0, params={"fields": ["event_type", "value"]}),
    FaultOp("corrupt_text", 0.4, 1.0, params={"columns": ["event_type"]}),
    FaultOp("time_skew_typed", 0.3, 3.0, params={"fields": ["ts"], "max_skew_s": 60}),
    FaultOp("duplicate_rows", 0.2, 1.0)), min_ops=0, max_ops=3, max_faults=2)


def plan_sql(key: str) -> str:
    """The plan drawn step by step: who fired, how many, tickets by cumulative weight, the cap."""
    ops = PLAN.ops
    fired = ", ".join(f"{u('plan#' + o.name, key)} < {dbl(o.p)} AS e{i}" for i, o in enumerate(ops))
    cums = ", ".join("(" + "+".join(f"CASE WHEN e{j} THEN {dbl(ops[j].weight)} ELSE {dbl(0)} END" for j in range(i + 1))
                     + f") AS c{i}" for i in range(len(ops)))
    n = "+".join(f"e{i}::INT" for i in range(len(ops)))
    name = "CASE " + " ".join(f"WHEN r < c{i} THEN '{o.name}'" for i, o in enumerate(ops)) + " END"
    return f"""fired AS (SELECT *, {fired} FROM events),
 cums AS (SELECT *, {cums}, least({below('plan#k', key, 4)}, {n}) AS k FROM fired),
 tickets AS (SELECT *, unnest(range(1, k+1)) AS j FROM cums),
 rolled AS (SELECT *, {u('plan#pick', f"{key}||'|'||j")}*c{len(ops) - 1} AS r, {digest('plan#cut', f"{key}||'|'||j")} AS h FROM tickets),
 plan AS (SELECT event_id, list(DISTINCT name) AS names FROM (SELECT event_id, {name} AS name FROM rolled
   QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY h) <= 2) GROUP BY 1)"""


@suite.add("f15_fault_plan", f"""WITH {plan_sql(E)}
SELECT event_id, coalesce(array_to_string(list_sort(names), ','), '') AS plan FROM events LEFT JOIN plan USING (event_id)""")
def fault_plan(spark, sf):
    from synthloom.plans.fault_plan import draw_plan
    df = draw_plan(events(spark, sf), PLAN, D, E)
    return df.select(E, F.array_join(F.array_sort("_plan"), ",").alias("plan"))


@suite.add("f16_fault_audit", f"""WITH {plan_sql(E)},
hits AS (SELECT unnest(names) AS op, event_id, event_type FROM plan JOIN events USING (event_id)),
dups AS (SELECT event_id, 2 AS n FROM hits WHERE op = 'duplicate_rows'),
rows AS (SELECT op, coalesce(n, 1) AS n FROM hits LEFT JOIN dups USING (event_id) WHERE op <> 'duplicate_rows'
  AND NOT (op = 'corrupt_text' AND EXISTS (SELECT 1 FROM hits h WHERE h.event_id = hits.event_id AND h.op = 'null_field')
   AND {digest('null_field#event_type', E)} < {digest('null_field#value', E)})
  UNION ALL SELECT op, 1 FROM hits WHERE op = 'duplicate_rows'),
total AS (SELECT (SELECT count(*) FROM events)+(SELECT count(*) FROM dups) AS t)
SELECT op, sum(n)::BIGINT AS executions, sum(n)::BIGINT AS rows, sum(n)::DOUBLE/(SELECT t FROM total) AS share FROM rows GROUP BY op""")
def fault_audit(spark, sf):
    return audit.fault_audit(apply_plan(events(spark, sf), PLAN, D, E))
