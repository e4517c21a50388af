"""Column synthesizers (scalar, nested, nullable, union), keyed by the rows of ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.common import SEED, Suite, below, digest, strings, table, text, u
from synthloom.functions import lists as L
from synthloom.sources.synth import synth_over

suite = Suite()
K = "o_orderkey"
NOW = "2025-06-15T10:30:00+00:00"
NOW_US = 1749983400000000
ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def over_orders(spark, sf, fields, **kw):
    spec = {"type": "object", "fields": fields}
    return synth_over(table(spark, sf, "orders"), spec, K, SEED, keep=[K], now=NOW,
                      kind="portable", **kw)


def register(name, fields, sql_cols, project=None):
    cols = ", ".join(f"{e} AS {n}" for n, e in sql_cols.items())

    @suite.add(name, f"SELECT {K}, {cols} FROM orders")
    def run(spark, sf):
        df = over_orders(spark, sf, fields)
        return df.select(K, *project()) if project else df
    return run


def dbl(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def rounded(x: str, digits: int) -> str:
    return f"(round_even(({x})*{dbl(10**digits)}, 0)/{dbl(10**digits)})"


def pick(words, path) -> str:
    return f"{strings(words)}[{below(path, K, len(words))}+1]"


def spelled(v: str, alphabet: str, size: int) -> str:
    b = len(alphabet)
    return "(" + "||".join(
        f"substr('{alphabet}', (({v})//{b**j})%{b}+1, 1)" for j in range(size - 1, -1, -1)) + ")"


def padded(path: str, size: int) -> str:
    return f"lpad({below(path, K, 10**size)}::VARCHAR, {size}, '0')"


# --- scalars ------------------------------------------------------------------------------------

register("g1_int", {"amount": {"type": "int", "min": 5, "max": 500, "step": 5}, "plain": "int"},
         {"amount": f"5+{below('amount', K, 100)}*5", "plain": below("plain", K, 101)})

register("g2_float", {"price": {"type": "float", "min": 5, "max": 500, "precision": 2}, "unit": "float"},
         {"price": rounded(f"{u('price', K)}*{dbl(495)}+{dbl(5)}", 2),
          "unit": f"{u('unit', K)}*{dbl(1)}+{dbl(0)}"})

register("g3_bool", {"flag": {"type": "bool", "p_true": 0.3}, "coin": "bool"},
         {"flag": f"{u('flag', K)} < {dbl(.3)}", "coin": f"{u('coin', K)} < {dbl(.5)}"})

TIER = f"{u('tier', K)}*{dbl(100)}"
register("g4_enum",
         {"color": {"type": "enum", "values": ["red", {"value": "green"}, "blue"]},
          "tier": {"type": "enum", "values": ["free", "pro", "enterprise"], "weights": [60, 30, 10]}},
         {"color": pick(["red", "green", "blue"], "color"),
          "tier": f"CASE WHEN {TIER} <= {dbl(60)} THEN 'free' WHEN {TIER} <= {dbl(90)} THEN 'pro' "
                  "ELSE 'enterprise' END"})

register("g5_template",
         {"order_ref": {"type": "string", "template": "ORD-{nnnnnn}/{nn}", "n_type": "numeric"},
          "iso": {"type": "string", "template": "ISO-{nnn}"},
          "low": {"type": "string", "template": "{nn}x", "n_type": "lower"},
          "hexed": {"type": "string", "template": "0x{nnnn}", "n_charset": "0123456789abcdef"}},
         {"order_ref": f"'ORD-'||{padded('order_ref#0.0', 6)}||'/'||{padded('order_ref#1.0', 2)}",
          "iso": "'ISO-'||" + spelled(below("iso#0.0", K, 26**3), ALPHA, 3),
          "low": spelled(below("low#0.0", K, 26**2), ALPHA.lower(), 2) + "||'x'",
          "hexed": "'0x'||" + spelled(below("hexed#0.0", K, 16**4), "0123456789abcdef", 4)})


def ch(i: int, alphabet: str) -> str:
    return f"substr('{alphabet}', {below(f'code#r{i}', K, len(alphabet))}+1, 1)"


register("g6_regex", {"code": {"type": "string", "regex": "^[A-Z]{2}[0-9]{4}(/[a-f]{1,2})?$"}},
         {"code": "||".join([ch(0, ALPHA), ch(1, ALPHA)] +
                            [ch(i, "0123456789") for i in (2, 3, 4, 5)]) +
          f"||CASE WHEN {below('code#r6', K, 2)} > 0 THEN '/'||{ch(7, 'abcdef')}||"
          f"CASE WHEN {below('code#r8', K, 2)} > 0 THEN {ch(9, 'abcdef')} ELSE '' END ELSE '' END",
          "valid": "true"},
         lambda: [F.col("code"), F.col("code").rlike("^[A-Z]{2}[0-9]{4}(/[a-f]{1,2})?$").alias("valid")])

_NO_DIGITS = "".join(chr(c) for c in range(32, 127) if not chr(c).isdigit())
register("g6_regex_open", {"code": {"type": "string", "regex": "[A-C]+x[^0-9]{20,40}"}},
         {"code": ch(0, "ABC") + "".join(f"||CASE WHEN {below('code#r1', K, 9)} > {i} THEN {ch(2 + i, 'ABC')} ELSE '' END" for i in range(8))
          + f"||'x'||array_to_string(list_transform(range(1, 21+{below('code#r10', K, 21)}), lambda j: "
            f"substr({text(_NO_DIGITS)}, {below('code#r11', K + "||'|'||j", len(_NO_DIGITS))}+1, 1)), '')"})

H = digest("uid#uuid", K)
register("g7_provider",
         {"word": {"type": "string", "string_type": "word"},
          "name": {"type": "string", "string_type": "name"},
          "city": {"type": "string", "string_type": "faker.city"},
          "state": {"type": "string", "string_type": "state"},
          "email": {"type": "string", "string_type": "email"},
          "url": {"type": "string", "string_type": "url"},
          "phone": {"type": "string", "string_type": "phone_number"},
          "uid": {"type": "string", "string_type": "uuid4"}},
         {"word": pick(L.WORDS, "word#word"),
          "name": pick(L.FIRST_NAMES, "name#first") + "||' '||" + pick(L.LAST_NAMES, "name#last"),
          "city": pick(L.CITIES, "city#city"), "state": pick(L.STATES, "state#state"),
          "email": f"lower({pick(L.FIRST_NAMES, 'email#first')})||'.'||lower("
                   f"{pick(L.LAST_NAMES, 'email#last')})||{padded('email#n', 3)}||'@'||"
                   + pick(L.MAIL_HOSTS, "email#host"),
          "url": f"'https://www.'||{pick(L.WORDS, 'url#word')}||'.'||"
                 f"{pick(L.MAIL_HOSTS, 'url#host')}||'/'||{padded('url#n', 4)}",
          "phone": f"'+1-'||{padded('phone#a', 3)}||'-555-'||{padded('phone#n', 4)}",
          "uid": f"substr({H},1,8)||'-'||substr({H},9,4)||'-4'||substr({H},14,3)||'-'||"
                 f"substr('89ab', ('0x'||substr({H},17,1))::INT%4+1, 1)||substr({H},18,3)||'-'||"
                 f"substr({H},21,12)"})

SIZE = f"(5+{below('note#len', K, 26)})"
BLOCK = "||".join(f"substr('{ALPHA.lower()}', (v//{26**j})%26+1, 1)" for j in range(8))
J_KEY = K + "||'|'||j"
register("g8_plain", {"note": {"type": "string", "min_length": 5, "max_length": 30}},
         {"note": "substr(array_to_string(list_transform(list_transform("
                  f"range(0, ({SIZE}-1)//8+1), lambda j: {below('note#c', J_KEY, 26**8)}), "
                  f"lambda v: {BLOCK}), ''), 1, {SIZE})"})

START_US, END_US = 1704067200000000, 1767225600000000  # 2024-01-01, 2026-01-01


def moment(path: str, start: int, end: int) -> str:
    return f"({start}+round_even({u(path, K)}*{dbl(end - start)}, 0)::BIGINT)"


def shown(us: str, fmt: str) -> str:
    return f"strftime(make_timestamp({us}), '{fmt}')"


TS = {"type": "timestamp", "start": "2024-01-01T00:00:00+00:00", "end": "2026-01-01T00:00:00+00:00"}
register("g9_timestamp", {"at": TS, "lately": "timestamp", "ms": {
    "type": "timestamp", "start": 1704067200000, "end": 1767225600}},
    {"at": moment("at", START_US, END_US), "ms": moment("ms", START_US, END_US),
     "lately": moment("lately", NOW_US - 365 * 86400000000, NOW_US)})

DAY_TEXT = {"type": "datetime", "start": "2024-01-01", "end": "2026-01-01", "format": "%Y%m%d"}
ISO_TEXT = {**DAY_TEXT, "format": "%Y-%m-%dT%H:%M:%S%z"}
register("g10_timestamp_depends_on",
         {"day_us": {"type": "timestamp", "depends_on": "day"},
          "iso_us": {"type": "timestamp", "depends_on": "iso"}, "day": DAY_TEXT, "iso": ISO_TEXT},
         {"day": shown(moment("day", START_US, END_US), "%Y%m%d"),
          "day_us": f"{moment('day', START_US, END_US)}//86400000000*86400000000",
          "iso": shown(moment("iso", START_US, END_US), "%Y-%m-%dT%H:%M:%S") + "||'+0000'",
          "iso_us": f"{moment('iso', START_US, END_US)}//1000000*1000000"})

register("g11_datetime",
         {"plain": {"type": "datetime", "start": "2024-01-01", "end": "2026-01-01"},
          "tbilisi": {"type": "datetime", "start": "2024-01-01", "end": "2026-01-01",
                      "format": "%d.%m.%y %H:%M:%S.%f %z", "tz": "+04:00"}},
         {"plain": shown(moment("plain", START_US, END_US), "%Y-%m-%dT%H:%M:%S") + "||'+0000'",
          "tbilisi": shown(moment("tbilisi", START_US, END_US) + "+14400000000",
                           "%d.%m.%y %H:%M:%S.%f") + "||' +0400'"})

DAY0 = NOW_US - NOW_US % 86400000000
register("g12_time_of_day",
         {"shift": {"type": "datetime", "time_start": "08:00", "time_end": "16:30:00",
                    "format": "%Y-%m-%d %H:%M:%S"},
          "late": {"type": "datetime", "time_start": "22:00:00", "format": "%H:%M:%S"}},
         {"shift": shown(moment("shift", DAY0 + 28800000000, DAY0 + 59400000000), "%Y-%m-%d %H:%M:%S"),
          "late": shown(moment("late", DAY0 + 79200000000, DAY0 + 86399000000), "%H:%M:%S")})

register("g13_datetime_depends_on",
         {"event_date": {"type": "datetime", "format": "%Y%m%d", "depends_on": "at"}, "at": TS},
         {"at": moment("at", START_US, END_US),
          "event_date": shown(moment("at", START_US, END_US), "%Y%m%d")})

SEQ = f"(1700000000000000+({K}+1)*1000000)"
register("g14_stateful_timestamp",
         {"tick": {"type": "stateful_timestamp", "start": 1700000000000000, "increment": 1000000},
          "capped": {"type": "stateful_timestamp", "start": 1700000000000000, "increment": 1000000,
                     "end": 1732380000000000}},
         {"tick": SEQ, "capped": f"least({SEQ}, 1732380000000000)"})

register("g15_stateful_datetime",
         {"tick": {"type": "stateful_datetime", "start": 1700000000000000, "increment": 1000000,
                   "format": "%Y-%m-%dT%H:%M:%S", "tz": "-02:30"}},
         {"tick": shown(SEQ + "-9000000000", "%Y-%m-%dT%H:%M:%S")})

# --- nested, nullable, union --------------------------------------------------------------------

register("n1_array",
         {"tags": {"type": "array", "min_items": 0, "max_items": 4,
                   "child": {"type": "string", "string_type": "word"}},
          "pair": {"type": "array", "min_items": 2, "child": {"type": "int", "min": 1, "max": 9}}},
         {"size": f"{below('tags#size', K, 5)}",
          "tags": f"array_to_string(list_transform(range(0, {below('tags#size', K, 5)}), lambda j: "
                  f"{strings(L.WORDS)}[{below('tags[]#word', J_KEY, len(L.WORDS))}+1]), ',')",
          "pair": f"array_to_string(list_transform(range(0, 2), lambda j: "
                  f"1+{below('pair[]', J_KEY, 9)}), ',')"},
         lambda: [F.size("tags").cast("bigint").alias("size"), F.array_join("tags", ",").alias("tags"),
          F.array_join(F.col("pair").cast("array<string>"), ",").alias("pair")])

register("n2_object",
         {"obj": {"type": "object", "fields": {
             "id": {"type": "int", "min": 1, "max": 5}, "ok": "bool",
             "deep": {"type": "object", "fields": {"label": {"type": "string", "string_type": "word"}}}}}},
         {"id": f"1+{below('obj.id', K, 5)}", "ok": f"{u('obj.ok', K)} < {dbl(.5)}",
          "label": pick(L.WORDS, "obj.deep.label#word")},
         lambda: [F.col("obj.id").alias("id"), F.col("obj.ok").alias("ok"), F.col("obj.deep.label").alias("label")])

MAYBE_INT = {"type": "maybe", "p_null": 0.5, "child": {"type": "int", "min": 1, "max": 5}}
register("n3_default_required",
         {"filled": {**MAYBE_INT, "default": 7}, "sure": {"type": "int", "required": True}},
         {"filled": f"CASE WHEN {u('filled#null', K)} >= {dbl(.5)} THEN 1+{below('filled.?', K, 5)} ELSE 7 END",
          "sure": below("sure", K, 101)})

register("n4_maybe",
         {"trace": {"type": "maybe", "p_null": 0.35, "child": {"type": "int", "max": 9}},
          "rare": {"type": "maybe", "child": "bool"}},
         {"trace": f"CASE WHEN {u('trace#null', K)} >= {dbl(.35)} THEN {below('trace.?', K, 10)} END",
          "rare": f"CASE WHEN {u('rare#null', K)} >= {dbl(.1)} THEN {u('rare.?', K)} < {dbl(.5)} END"})

register("n5_object_or_null",
         {"a": {"type": "object_or_null", "p_null": 0.25, "fields": {"x": "int"}},
          "b": {"type": "object_or_null", "weights": [3, 1], "of": {"type": "object", "fields": {"y": "bool"}}}},
         {"has_a": f"{u('a#null', K)} >= {dbl(.25)}",
          "x": f"CASE WHEN {u('a#null', K)} >= {dbl(.25)} THEN {below('a.?.x', K, 101)} END",
          "y": f"CASE WHEN {u('b#null', K)} >= {dbl(.25)} THEN {u('b.?.y', K)} < {dbl(.5)} END"},
         lambda: [F.col("a").isNotNull().alias("has_a"), F.col("a.x").alias("x"), F.col("b.y").alias("y")])

register("n6_string_or_null",
         {"city": {"type": "string_or_null", "of": {"type": "string", "string_type": "city"},
                   "weights": [3, 1]},
          "even": {"type": "string_or_null", "of": {"type": "string", "string_type": "state"}}},
         {"city": f"CASE WHEN {u('city#null', K)} >= {dbl(.25)} THEN {pick(L.CITIES, 'city.?#city')} END",
          "even": f"CASE WHEN {u('even#null', K)} >= {dbl(.5)} THEN {pick(L.STATES, 'even.?#state')} END"})

MIX = f"{u('mix#pick', K)}*{dbl(8)}"
register("n7_one_of",
         {"name": {"type": "one_of", "choices": [
             {"type": "string", "template": "page_view"}, {"type": "string", "template": "scroll"},
             {"type": "string", "template": "v{n}", "n_type": "numeric"}]},
          "mix": {"type": "one_of", "weights": [3, 5], "choices": [
              {"type": "int", "min": 40, "max": 55},
              {"type": "string", "template": "lot {nn}", "n_type": "numeric"}]},
          "val": {"type": "one_of", "choices": [
              {"type": "object", "fields": {"i": "int"}}, {"type": "object", "fields": {"b": "bool"}}]}},
         {"name": f"CASE {below('name#pick', K, 3)} WHEN 0 THEN 'page_view' WHEN 1 THEN 'scroll' "
                  f"ELSE 'v'||{padded('name|2#0.0', 1)} END",
          "mix": f"CASE WHEN {MIX} <= {dbl(3)} THEN (40+{below('mix|0', K, 16)})::VARCHAR "
                 f"ELSE '\"lot '||{padded('mix|1#0.0', 2)}||'\"' END",
          "i": f"CASE WHEN {below('val#pick', K, 2)} = 0 THEN {below('val|0.i', K, 101)} END",
          "b": f"CASE WHEN {below('val#pick', K, 2)} = 1 THEN {u('val|1.b', K)} < {dbl(.5)} END"},
         lambda: [F.col("name"), F.to_json("mix").alias("mix"), F.col("val.i").alias("i"), F.col("val.b").alias("b")])


def race(k: str, w: float) -> str:
    return f"(-ln({dbl(1)}-{u(f'sel.{k}#race', K)})/{dbl(w)})"


_SELECT = f"""
WITH r AS (SELECT {K}, 1+{below('sel#count', K, 2)} AS k, {race('a', 5)} AS ra, {race('b', 1)} AS rb,
  {race('c', 1)} AS rc, {below('sel.req', K, 101)} AS req, {below('sel.a', K, 101)} AS a,
  {u('sel.b', K)} < {dbl(.5)} AS b, {pick(L.WORDS, 'sel.c#word')} AS c FROM orders)
SELECT {K}, req, CASE WHEN (rb<ra)::INT+(rc<ra)::INT < k THEN a END AS a,
  CASE WHEN (ra<=rb)::INT+(rc<rb)::INT < k THEN b END AS b,
  CASE WHEN (ra<=rc)::INT+(rb<=rc)::INT < k THEN c END AS c FROM r"""


@suite.add("n8_select", _SELECT)
def select_keys(spark, sf):
    df = over_orders(spark, sf, {"sel": {
        "type": "select", "pick": {"mode": "range", "min": 1, "max": 2, "weights": {"a": 5}},
        "options": {"req": {"of": "int", "required": True}, "a": {"of": "int"}, "b": {"of": "bool"},
                    "c": {"of": {"type": "string", "string_type": "word"}}}}})
    return df.select(K, "sel.*")


register("n9_depends_on_order",
         {"c": {"type": "datetime", "depends_on": "b", "format": "%Y/%m/%d"},
          "b": {"type": "timestamp", "depends_on": "a"}, "a": DAY_TEXT,
          "inner": {"type": "object", "fields": {
              "day": {"type": "datetime", "depends_on": "us", "format": "%j"}, "us": TS}}},
         {"a": shown(moment("a", START_US, END_US), "%Y%m%d"),
          "b": f"{moment('a', START_US, END_US)}//86400000000*86400000000",
          "c": shown(moment("a", START_US, END_US), "%Y/%m/%d"),
          "day": shown(moment("inner.us", START_US, END_US), "%j")},
         lambda: [F.col("a"), F.col("b"), F.col("c"), F.col("inner.day").alias("day")])
