"""Faults inside JSON texts of five levels, made of the given rows; the SQL twins edit a list of the texts' tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import Suite, below, digest, strings, table, text, u
from suite.faults import _SPREAD, D, E, corrupted, cut, hit
from synthloom.functions import text as TX
from synthloom.operators import json_faults as J

suite = Suite()

# Tokens of a text, white space before them; None stands for a value of the row.
TOKENS = ['{', '"id"', ':', None, ',', ' "a"', ':', ' {', '"k"', ':', ' [', None, ',', ' {', '"deep"', ':', ' {', '"er"', ':', None,
          '}', '}', ']', ',', '\n "t"', ':', None, '}', '}']
VALUES = ["event_id::VARCHAR", "user_id::VARCHAR", """' "'||event_type||'"'""", """' "'||event_type||'! x"'"""]
# (first token, last token, path) of all values, and (key, last token of its value, path) of all keys.
NODES = [(0, 28, ""), (3, 3, "id"), (7, 27, "a"), (10, 22, "a.k"), (11, 11, "a.k[0]"), (13, 21, "a.k[1]"), (16, 20, "a.k[1].deep"),
         (19, 19, "a.k[1].deep.er"), (26, 26, "a.t")]
KEYS = [(1, 3, "id"), (5, 27, "a"), (8, 22, "a.k"), (14, 20, "a.k[1].deep"), (17, 19, "a.k[1].deep.er"), (24, 26, "a.t")]
TEXTS = [n for n in NODES if n[0] in (19, 26)]


def docs(spark, sf):
    own = iter([F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.concat(F.lit(' "'), "event_type", F.lit('"')),
                F.concat(F.lit(' "'), "event_type", F.lit('! x"'))])
    parts = [next(own) if t is None else F.lit(t) for t in TOKENS]
    return table(spark, sf, "events").select(E, F.concat(*parts).alias("doc"))


def pieces() -> str:
    own = iter(VALUES)
    return "[" + ", ".join(next(own) if t is None else "'" + t + "'" for t in TOKENS) + "]"


def twin(op: str, p: float, nodes: list, lo: int, hi: int, edits: str, note: str) -> str:
    """SQL of one operator: ``edits`` selects (event_id, s, e, v, note) from the chosen nodes (event_id, t, i, e, path)."""
    ranked = "list_sort([" + ", ".join(f"{{'h': {digest(op + '#node', f'{E}||{chr(39)}|{i}{chr(39)}')}, 'i': {i}}}" for i, _, _ in nodes) + "])"
    most = min(hi, len(nodes))
    count = f"{min(lo, most)}+{below(op + '#n', E, most - min(lo, most) + 1)}"
    rows = ", ".join(f"({i}, {e}, '{path}')" for i, e, path in nodes)
    return f"""
WITH d AS (SELECT event_id, event_type, {pieces()} AS t, {hit(op, p)} AS h FROM events),
drawn AS (SELECT event_id, t, unnest(list_transform({ranked}[1:{count}], lambda x: x.i)) AS i FROM d WHERE h),
spans AS (SELECT event_id, t, n.* FROM drawn JOIN (VALUES {rows}) n(i, e, path) USING (i)),
chosen AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.event_id = a.event_id AND b.i <> a.i AND b.i <= a.i AND b.e >= a.e)),
edits AS ({edits}),
notes AS (SELECT event_id, {note} AS faults FROM edits GROUP BY 1),
parts AS (SELECT event_id, unnest(t) AS piece, unnest(range(0, len(t))) AS j FROM d),
made AS (SELECT p.event_id, string_agg(CASE WHEN x.s IS NULL THEN piece WHEN x.s = j THEN regexp_extract(piece, '^[ \\n]*')||x.v ELSE '' END, '' ORDER BY j) AS doc
  FROM parts p LEFT JOIN edits x ON x.event_id = p.event_id AND j BETWEEN x.s AND x.e GROUP BY 1)
SELECT event_id, doc, coalesce(faults, '') AS faults FROM made LEFT JOIN notes USING (event_id)"""


def listed(op: str) -> str:
    return f"'{op}(doc '||string_agg(note, ', ' ORDER BY s)||')'"


def show(df):
    return df.select(E, "doc", F.array_join("_faults", ";").alias("faults"))


_STAYS = """EXISTS (SELECT 1 FROM (VALUES (1, 5), (8, 24)) b(before, i) WHERE b.i = c.i
 AND NOT EXISTS (SELECT 1 FROM chosen o WHERE o.event_id = c.event_id AND o.i = b.before))"""


@suite.add("f5_partial_load_nested", twin("partial_load", 0.3, KEYS, 1, 3, f"""
SELECT event_id, CASE WHEN stays THEN i-1 ELSE i END AS s, CASE WHEN NOT stays AND i IN (1, 8) THEN e+1 ELSE e END AS e, '' AS v, path AS note
FROM (SELECT *, {_STAYS} AS stays FROM chosen c)""", "'partial_load(doc drop:'||string_agg(note, ',' ORDER BY note)||')'"))
def partial_load_nested(spark, sf):
    return show(J.partial_load_json(docs(spark, sf), D, E, "doc", p=0.3, max_keys=3))


_RAW = "ltrim(array_to_string(t[i+1:e+1], ''))"
_AT = f"{E}||'|'||i"


@suite.add("f7_truncate_nested", twin("truncate_json", 0.3, NODES, 1, 3, f"""
SELECT event_id, i AS s, e, CASE WHEN i = 0 THEN part ELSE to_json(part)::VARCHAR END AS v, path||':'||length(part)||'/'||length(raw) AS note
FROM (SELECT *, {cut('raw', _AT)} AS part FROM (SELECT *, {_RAW} AS raw FROM chosen))""", listed("truncate_json")))
def truncate_nested(spark, sf):
    return show(J.truncate_json_nodes(docs(spark, sf), D, E, "doc", p=0.3, max_nodes=3, unit="chars"))


@suite.add("f8_bloat_nested", twin("bloat", 0.2, TEXTS, 1, 1, f"""
SELECT event_id, i AS s, e, to_json(substr(old,1,pos)||pad||substr(old,pos+1))::VARCHAR AS v, path||',+1024 insert' AS note
FROM (SELECT *, floor({u('bloat#at', _AT)}*(length(old)+1)::DOUBLE)::BIGINT AS pos, substr(array_to_string(list_transform(range(0, 32), lambda j:
  translate({digest('bloat#pad', f"{_AT}||'|'||j")}, '0123456789abcdef', {text(_SPREAD)})), ''), 1, 1024) AS pad
  FROM (SELECT *, {_RAW}[2:-2] AS old FROM chosen))""", listed("bloat")))
def bloat_nested(spark, sf):
    return show(J.bloat_json(docs(spark, sf), D, E, "doc", p=0.2, extra_kb=1))


def damage(op: str) -> str:
    return f"""
SELECT event_id, i AS s, i AS e, to_json({corrupted('old', 'how', 'up', 'uc')})::VARCHAR AS v, path||' '||{strings(TX.STRATEGIES)}[how+1] AS note
FROM (SELECT *, ltrim(t[i+1], E' \\n')[2:-2] AS old, {below(op + '#how', _AT, 9)} AS how, {u(op + '#pos', _AT)} AS up, {u(op + '#chr', _AT)} AS uc FROM chosen)"""


@suite.add("f9_corrupt_nested", twin("corrupt_text", 0.4, TEXTS, 1, 2, damage("corrupt_text"), listed("corrupt_text")))
def corrupt_nested(spark, sf):
    return show(J.corrupt_json_text(docs(spark, sf), D, E, "doc", p=0.4, max_fields=2))


@suite.add("f10_corrupt_key_nested", twin("corrupt_key", 0.4, KEYS, 1, 3, damage("corrupt_key"), listed("corrupt_key")).replace(
    "AND b.e >= a.e)", "AND b.e >= a.e AND false)"))  # keys do not lie inside one another
def corrupt_key_nested(spark, sf):
    return show(J.corrupt_key(docs(spark, sf), D, E, "doc", p=0.4, max_keys=3))
