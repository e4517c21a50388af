"""Faults inside JSON texts, at any depth: keys lost or renamed, nodes cut, strings damaged or grown.

Same contract as ``faults``: ``op(df, draw, key, column, ...)``, all choices are draws on ``key``. A hit text is scanned
once for its tokens; min..max of its n candidate nodes are drawn without replacement by the rank of (key, node), where
one chosen node lies inside another the outer one counts, and the edits are spliced into the text: every byte outside
of them stays as it was. Texts that are not valid JSON are left alone. The audit names each node by its exact path.
Narrow projections of built-in functions: they run on streams and never shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.functions import lists as L
from synthloom.functions import spans as P
from synthloom.functions import text as X
from synthloom.functions.draw import Draw, below, text_key
from synthloom.operators.faults import AUDIT, META, NO_FAULTS, ensure_audit, hit_column, noted, replace_columns
from synthloom.plans.compile import let

EDITS = "array<struct<s:int,e:int,v:string,at:int,note:string>>"


def _applied(df: DataFrame, draw: Draw, key: str, column: str, op: str, p: float, hit: Column | None, lo: int, hi: int,
             want: Callable[[Column, Column, Column], Column], edits: Callable[[Column, Column, Column], Column],
             label: Callable[[Column], Column], missing: bool = False) -> DataFrame:
    """Draw lo..hi of the nodes that ``want(text, tokens, i)`` holds for and splice ``edits(text, tokens, picks)``.

    All of it is one expression that names the column twice, so chained operators do not multiply their plans.
    """
    def chosen(text: Column, t: Column) -> Column:
        def drawn(nodes: Column) -> Column:
            most = F.least(F.size(nodes), F.lit(hi))
            least = F.least(F.lit(lo), most)
            count = (least + below(draw.u(f"{op}#n", F.col(key)), most - least + 1)).cast("int")
            ranked = F.array_sort(F.transform(nodes, lambda i: F.struct(draw.rank(f"{op}#node", F.col(key), i).alias("h"), i.alias("i"))))
            return F.when(F.size(nodes) > 0, F.transform(F.slice(ranked, F.lit(1), count), lambda x: x["i"])).otherwise(F.array().cast("array<int>"))
        return let(P.indices(t, lambda t, i: want(text, t, i)), drawn)

    def result(text: Column, done: Column, note: Column, gone: Column) -> Column:
        return F.struct(text.alias("old"), done.alias("new"), note.cast("string").alias("note"), gone.cast(NO_FAULTS).alias("gone"))

    def spliced(text: Column, es: Column) -> Column:
        return F.when(F.size(es) > 0, result(text, P.splice_all(text, es), label(es), F.array_sort(F.transform(es, lambda x: x["note"])))).otherwise(
            result(text, text, F.lit(None), F.array()))

    def work(text: Column) -> Column:
        inside = let(P.tokens(text), lambda t: let(chosen(text, t), lambda picks: let(edits(text, t, picks).cast(EDITS), lambda es: spliced(text, es))))
        return F.when(F.try_parse_json(text).isNotNull(), inside).otherwise(result(text, text, F.lit(None), F.array()))

    text = F.col(column)
    staged = ensure_audit(df).withColumn("_done", F.when(hit_column(draw, op, key, p, hit), let(text, work)).otherwise(
        result(text, text, F.lit(None), F.array())))
    new = {column: F.col("_done.new"), AUDIT: noted(F.col("_done.note").isNotNull(), F.col("_done.note"))}
    if missing:
        new["_missing"] = F.col("_done.gone")
    return replace_columns(staged, new, ("_done",))


def _noted(op: str, column: str) -> Callable[[Column], Column]:
    """Label that names all edits in the order of their places."""
    return lambda es: F.concat(F.lit(f"{op}({column} "), F.array_join(F.transform(F.array_sort(es), lambda x: x["note"]), ", "), F.lit(")"))


def _edit(s: Column, e: Column, v: Column, at: Column, note: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"), v.alias("v"), at.alias("at"), note.alias("note"))


def _drawn_text(draw: Draw, op: str, key: str, i: Column, s: Column) -> tuple[Column, Column]:
    """(damaged text, strategy) of node ``i``, from draws on (key, node)."""
    k = text_key(F.col(key), i)
    how = X.strategy_name(draw, op, k)
    return X.corrupt(s, how, draw.u(f"{op}#pos", k), draw.u(f"{op}#chr", k)), how


def _size(t: Column, i: Column) -> Column:
    return F.get(t, i)["e"] - F.get(t, i)["s"]


def partial_load_json(df: DataFrame, draw: Draw, key: str, column: str, *, p: float = 0.1, min_keys: int = 1,
                      max_keys: int = 3, hit: Column | None = None) -> DataFrame:
    """Lose min..max keys at any depth, also inside lists. ``_missing`` lists the paths; ``__meta`` is protected."""
    meta = f'"{META}"'

    def want(text: Column, t: Column, i: Column) -> Column:
        return P.is_key(t, i) & F.when(_size(t, i) == len(meta), P.raw(text, t, i) != meta).otherwise(F.lit(True))

    def edits(text: Column, t: Column, picks: Column) -> Column:
        def cut(kept: Column, i: Column) -> Column:
            """With the comma before it if a member before it stays, else with the comma after it."""
            depth, start, end = F.get(t, i)["d"], F.array_max(P.around(t, i)), P.last(t, i + 2)
            stays = F.exists(F.sequence(start, i), lambda j: (j < i) & P.is_key(t, j) & (F.get(t, j)["d"] == depth) & ~F.array_contains(kept, j))
            more = P.first(t, end + 1) == ","
            return _edit(F.when(stays, F.get(t, i - 1)["s"]).otherwise(F.get(t, i)["s"]),
                         F.when(~stays & more, F.get(t, end + 1)["e"]).otherwise(F.get(t, end)["e"]), F.lit(""), i, P.path(text, t, i))
        span = lambda i: (F.get(t, i)["s"], F.get(t, P.last(t, i + 2))["e"])
        return let(P.outermost(picks, span), lambda kept: F.transform(kept, lambda i: cut(kept, i)))

    label = lambda es: F.concat(F.lit(f"partial_load({column} drop:"), F.array_join(
        F.array_sort(F.transform(es, lambda x: x["note"])), ","), F.lit(")"))
    return _applied(df, draw, key, column, "partial_load", p, hit, min_keys, max_keys, want, edits, label, missing=True)


def truncate_json_nodes(df: DataFrame, draw: Draw, key: str, column: str, *, p: float = 0.1, min_nodes: int = 1,
                        max_nodes: int = 1, unit: str = "bytes", hit: Column | None = None) -> DataFrame:
    """Replace min..max nodes at any depth by a string: their JSON text, cut somewhere inside.

    If the root is among them the whole text is cut instead, and is no longer JSON.
    """
    cut = {"bytes": X.cut_bytes, "chars": X.cut_chars}[unit]

    def edits(text: Column, t: Column, picks: Column) -> Column:
        span = lambda i: (F.get(t, i)["s"], F.get(t, P.last(t, i))["e"])

        def cut_at(i: Column) -> Column:
            def made(whole: Column, part: Column) -> Column:
                note = F.concat(P.path(text, t, i), F.lit(":"), F.length(part).cast("string"), F.lit("/"), F.length(whole).cast("string"))
                return _edit(*span(i), F.when(i > 0, P.quoted(part)).otherwise(part), i, note)
            return let(P.node_text(text, t, i), lambda whole: let(cut(whole, draw.u("truncate_json#at", F.col(key), i)), lambda part: made(whole, part)))
        return F.transform(P.outermost(picks, span), cut_at)

    return _applied(df, draw, key, column, "truncate_json", p, hit, min_nodes, max_nodes, lambda text, t, i: P.is_value(t, i), edits,
                    _noted("truncate_json", column))


def corrupt_json_text(df: DataFrame, draw: Draw, key: str, column: str, *, p: float = 0.1, min_fields: int = 1,
                      max_fields: int = 1, hit: Column | None = None) -> DataFrame:
    """Change the values of min..max strings at any depth by one of nine strategies each."""
    def edits(text: Column, t: Column, picks: Column) -> Column:
        def made(i: Column, old: Column) -> Column:
            new, how = _drawn_text(draw, "corrupt_text", key, i, old)
            return _edit(F.get(t, i)["s"], F.get(t, i)["e"], P.quoted(new), i, F.concat(P.path(text, t, i), F.lit(" "), how))
        return F.transform(picks, lambda i: let(P.unquoted(P.raw(text, t, i)), lambda old: made(i, old)))

    return _applied(df, draw, key, column, "corrupt_text", p, hit, min_fields, max_fields, lambda text, t, i: P.is_text(t, i), edits,
                    _noted("corrupt_text", column))


def corrupt_key(df: DataFrame, draw: Draw, key: str, column: str, *, p: float = 0.1, min_keys: int = 1, max_keys: int = 1,
                hit: Column | None = None) -> DataFrame:
    """Rename min..max keys at any depth; a name that the object has already gets a zero-width space."""
    def edits(text: Column, t: Column, picks: Column) -> Column:
        def made(i: Column, old: Column) -> Column:
            depth, start = F.get(t, i)["d"], F.array_max(P.around(t, i))
            others = F.transform(
                F.filter(F.sequence(start, P.last(t, start)), lambda j: P.is_key(t, j) & (F.get(t, j)["d"] == depth) & (j != i)),
                lambda j: P.unquoted(P.raw(text, t, j)))
            new, how = _drawn_text(draw, "corrupt_key", key, i, old)
            name = let(new, lambda n: F.when(F.array_contains(others, n), F.concat(n, F.lit(L.ZERO_WIDTH[0]))).otherwise(n))
            return let(name, lambda n: F.when(n != old, _edit(
                F.get(t, i)["s"], F.get(t, i)["e"], P.quoted(n), i, F.concat(P.path(text, t, i), F.lit(" "), how))))
        return F.array_compact(F.transform(picks, lambda i: let(P.unquoted(P.raw(text, t, i)), lambda old: made(i, old))))

    return _applied(df, draw, key, column, "corrupt_key", p, hit, min_keys, max_keys, lambda text, t, i: P.is_key(t, i) & (_size(t, i) > 2), edits,
                    _noted("corrupt_key", column))


def bloat_json(df: DataFrame, draw: Draw, key: str, column: str, *, p: float = 0.1, extra_kb: int = 32,
               strategy: str = "insert", hit: Column | None = None) -> DataFrame:
    """Grow one string value at any depth by ``extra_kb`` KiB, as ``faults.bloat`` grows a column."""
    need = extra_kb * 1024

    def edits(text: Column, t: Column, picks: Column) -> Column:
        def made(i: Column, old: Column) -> Column:
            k = text_key(F.col(key), i)
            pad = X.padding(draw, "bloat#pad", k, need)
            at = below(draw.u("bloat#at", k), F.length(old) + 1)
            new = X.splice(old, at, 0, pad) if strategy == "insert" else F.when(F.length(old) > 0, X.repeat_tail(old, need)).otherwise(pad)
            return _edit(F.get(t, i)["s"], F.get(t, i)["e"], P.quoted(new), i, F.concat(P.path(text, t, i), F.lit(f",+{need} {strategy}")))
        return F.transform(picks, lambda i: let(P.unquoted(P.raw(text, t, i)), lambda old: made(i, old)))

    if need <= 0:
        return ensure_audit(df)
    return _applied(df, draw, key, column, "bloat", p, hit, 1, 1, lambda text, t, i: (P.first(t, i) == '"') & ~P.is_key(t, i), edits,
                    _noted("bloat", column))
