"""Where the nodes of a JSON text stand, so that edits can be spliced into the text and leave the rest alone.

One scan splits the text into tokens with their places and depths. A node is the index (from 0) of its first token: of
a scalar, of an opening bracket, or of a member's key. Everything else (ends, paths, siblings) is looked up for the few
nodes that are chosen. Places count characters; texts are expected to be valid JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from synthloom.plans.compile import let

# A token with the white space before it. Possessive parts keep the matcher from recursing on long strings.
TOKEN = r'[ \t\n\r]*+(?:"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|[{}\[\]:,]|[^ \t\n\r{}\[\]:,"]++)'
SPACE = " \t\n\r"
CHUNK = 64  # tokens whose places are summed at once, so that long texts are not copied token by token
PLAIN_KEY = r'^"[A-Za-z_][A-Za-z0-9_]*"$'


def tokens(text: Column) -> Column:
    """Array of (c, s, e, d): first character, start, end, and how many brackets are open around the token."""
    shape = "struct<c:string,s:int,e:int,d:int>"

    def place(seen: Column, raw: Column) -> Column:
        def with_body(body: Column) -> Column:
            c = F.substring(body, F.lit(1), F.lit(1))
            end = seen["pos"] + F.length(raw)
            depth = seen["dep"] - c.isin("}", "]").cast("int")
            token = F.struct(c.alias("c"), (end - F.length(body)).alias("s"), end.alias("e"), depth.alias("d"))
            return F.struct(end.alias("pos"), (depth + c.isin("{", "[").cast("int")).alias("dep"), F.concat(seen["out"], F.array(token)).alias("out"))
        return let(F.ltrim(raw, F.lit(SPACE)), with_body)

    def part(seen: Column, chunk: Column) -> Column:
        start = F.struct(seen["pos"].alias("pos"), seen["dep"].alias("dep"), F.array().cast(f"array<{shape}>").alias("out"))
        done = F.aggregate(chunk, start, place)
        return let(done, lambda x: F.struct(x["pos"].alias("pos"), x["dep"].alias("dep"), F.concat(seen["out"], F.array(x["out"])).alias("out")))

    def whole(raws: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(raws) - 1) / CHUNK).cast("int")),
                             lambda i: F.slice(raws, i * CHUNK + 1, F.lit(CHUNK)))
        zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("dep"), F.array().cast(f"array<array<{shape}>>").alias("out"))
        return F.when(F.size(raws) > 0, F.flatten(F.aggregate(chunks, zero, part, lambda x: x["out"])))
    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), whole)


def first(t: Column, i: Column) -> Column:
    """First character of token ``i``; empty beyond the ends."""
    return F.coalesce(F.get(t, i)["c"], F.lit(""))


def is_key(t: Column, i: Column) -> Column:
    return first(t, i + 1) == ":"


def is_value(t: Column, i: Column) -> Column:
    return ~first(t, i).isin(":", ",", "}", "]") & ~is_key(t, i)


def is_text(t: Column, i: Column) -> Column:
    """A string value with something in it."""
    return (first(t, i) == '"') & ~is_key(t, i) & (F.get(t, i)["e"] - F.get(t, i)["s"] > 2)


def indices(t: Column, want: Callable[[Column, Column], Column]) -> Column:
    """Indices of the tokens that ``want`` holds for."""
    every = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: want(t, i))


def last(t: Column, i: Column) -> Column:
    """Index of the last token of value ``i``."""
    closing = F.array_min(F.filter(F.sequence(i, F.size(t) - 1), lambda j: first(t, j).isin("}", "]") & (F.get(t, j)["d"] == F.get(t, i)["d"])))
    return F.when(first(t, i).isin("{", "["), closing).otherwise(i)


def member_value(t: Column, i: Column) -> Column:
    """Index of the value of a key, or of a value itself."""
    return F.when(is_key(t, i), i + 2).otherwise(i)


def around(t: Column, i: Column) -> Column:
    """Indices of the opening brackets around token ``i``, outermost first."""
    def at(level: Column) -> Column:
        return F.array_max(F.filter(F.sequence(F.lit(0), i - 1), lambda j: first(t, j).isin("{", "[") & (F.get(t, j)["d"] == level)))
    depth = F.get(t, i)["d"]
    return F.when(depth > 0, F.transform(F.sequence(F.lit(0), depth - 1), at)).otherwise(F.array().cast("array<int>"))


def raw(text: Column, t: Column, i: Column) -> Column:
    """Text of token ``i``."""
    return F.substring(text, F.get(t, i)["s"] + 1, F.get(t, i)["e"] - F.get(t, i)["s"])


def node_text(text: Column, t: Column, i: Column) -> Column:
    """Text of value ``i`` with all inside."""
    return F.substring(text, F.get(t, i)["s"] + 1, F.get(t, last(t, i))["e"] - F.get(t, i)["s"])


def path(text: Column, t: Column, i: Column) -> Column:
    """Path of a value or key: ``a.b[2].c``; a key that is not a plain name stands in its quotes. The root's is empty."""
    def step(chain: Column, m: Column) -> Column:
        x, up = F.get(chain, m), F.get(chain, m - 1)
        key = raw(text, t, x - 2)
        name = F.when(key.rlike(PLAIN_KEY), F.substring(key, F.lit(2), F.length(key) - 2)).otherwise(key)
        before = F.filter(F.sequence(up, x), lambda j: (first(t, j) == ",") & (F.get(t, j)["d"] == F.get(t, x)["d"]))
        return F.when(first(t, x - 1) == ":", F.concat(F.lit("."), name)).otherwise(
            F.concat(F.lit("["), F.size(before).cast("string"), F.lit("]")))
    steps = let(F.concat(around(t, i), F.array(member_value(t, i))), lambda chain: F.when(
        F.size(chain) > 1, F.array_join(F.transform(F.sequence(F.lit(1), F.size(chain) - 1), lambda m: step(chain, m)), "")).otherwise(F.lit("")))
    return F.regexp_replace(steps, r"^\.", "")


def unquoted(r: Column) -> Column:
    """The string that a JSON string token stands for."""
    return F.get_json_object(F.concat(F.lit('{"x":'), r, F.lit("}")), "$.x")


def quoted(s: Column) -> Column:
    """A JSON string token."""
    return let(F.to_json(F.array(s)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def splice_all(text: Column, edits: Column) -> Column:
    """``text`` with the spans of ``edits`` (array of s, e, v; none overlaps another) replaced; the rest is untouched."""
    def put(es: Column) -> Column:
        done = lambda j: F.when(j > 0, F.get(es, j - 1)["e"]).otherwise(0)
        parts = F.transform(es, lambda x, j: F.concat(F.substring(text, done(j) + 1, x["s"] - done(j)), x["v"]))
        tail = F.substring(text, done(F.size(es)) + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), tail)
    return let(F.array_sort(edits), put)


def outermost(picks: Column, span: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Those of the chosen nodes that do not lie inside another chosen one."""
    def inside(i: Column, j: Column) -> Column:
        (a, b), (c, d) = span(i), span(j)
        return (i != j) & (a >= c) & (b <= d)
    return F.filter(picks, lambda i: ~F.exists(picks, lambda j: inside(i, j)))
