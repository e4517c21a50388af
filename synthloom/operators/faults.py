"""Fault operators: a table goes in, a damaged table with an audit column comes out.

Common contract: ``op(df, draw, key, ...)``. ``key`` names a column that identifies the row; all
choices are draws on it. ``p`` is the chance per row; ``hit`` (a boolean column) overrides it, which
is how a fault plan steers the operators. Each operator appends ``op(detail)`` to ``_faults``.
All row-scoped operators are narrow projections, so they work on streams and never shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.functions import lists as L
from synthloom.functions import text as X
from synthloom.functions.draw import Draw, below
from synthloom.functions.times import SECOND, clock_to_micros, format_micros, micros_to_clock, text_to_micros
from synthloom.plans.compile import let
from synthloom.session import hash_position, lookup_join, top_per_key

AUDIT = "_faults"
NO_FAULTS = "array<string>"
META = "__meta"


def ensure_audit(df: DataFrame) -> DataFrame:
    return df if AUDIT in df.columns else df.withColumn(AUDIT, F.array().cast(NO_FAULTS))


def hit_column(draw: Draw, op: str, key: str, p: float, hit: Column | None) -> Column:
    return F.coalesce(hit, F.lit(False)) if hit is not None else draw.u(f"{op}#hit", F.col(key)) < p


def noted(when: Column, label: Column) -> Column:
    """Audit column with ``label`` appended where ``when`` holds."""
    return F.when(when, F.concat(F.col(AUDIT), F.array(label))).otherwise(F.col(AUDIT))


def replace_columns(df: DataFrame, new: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """One projection with some columns replaced, temporaries dropped and order kept."""
    kept = [new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns if c not in drop]
    extra = [e.alias(c) for c, e in new.items() if c not in df.columns]
    return df.select(*kept, *extra)


def string_columns(df: DataFrame, key: str) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name != key and not f.name.startswith("_")]


# --- rows ---------------------------------------------------------------------------------------

def duplicate_rows(df: DataFrame, draw: Draw, key: str, *, p: float = 0.1, max_dups: int = 1,
                   strategy: str = "adjacent", hit: Column | None = None) -> DataFrame:
    """Copies of random rows, 1..max_dups per hit row.

    ``_copy`` is 0 on the original. ``_ord`` tells where a row belongs: a copy shares its original's
    place (adjacent) or gets another row's random place (random); sort by (_ord, _copy) on demand.
    """
    times = F.when(F.col("_hit"), below(draw.u("duplicate_rows#n", F.col(key)), max_dups) + 1).otherwise(0)
    out = (ensure_audit(df).withColumn("_hit", hit_column(draw, "duplicate_rows", key, p, hit))
           .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), times.cast("bigint")))))
    return _placed(out, draw, key, strategy).drop("_hit")


def _placed(df: DataFrame, draw: Draw, key: str, strategy: str) -> DataFrame:
    at = draw.digest("duplicate_rows#at", F.col(key))
    if strategy == "random":
        at = F.when(F.col("_copy") > 0, draw.digest("duplicate_rows#at", F.col(key), F.col("_copy"))).otherwise(at)
    label = F.concat(F.lit("duplicate_rows("), F.col("_copy").cast("string"), F.lit(")"))
    return replace_columns(df, {"_ord": at, AUDIT: noted(F.col("_copy") > 0, label)})


def duplicate_rows_in_batch(df: DataFrame, draw: Draw, key: str, batch: str, *, max_dups: int = 1,
                            strategy: str = "adjacent", count_col: str | None = None) -> DataFrame:
    """Exactly ``min(max_dups, rows)`` extra rows per batch: the rows with the smallest hashes.

    Only (batch, key, hash) is ranked. ``count_col`` (a list length kept beside the rows) is raised.
    """
    df = ensure_audit(df)
    ranked = df.select(batch, key).withColumn("_h", draw.rank("duplicate_rows#pick", F.col(key)))
    picks = top_per_key(ranked, [batch], [F.col("_h")], max_dups).select(batch, key)
    copies = df.join(picks, [batch, key], "left_semi").withColumn("_copy", F.lit(1).cast("bigint"))
    both = df.withColumn("_copy", F.lit(0).cast("bigint")).unionByName(copies)
    if count_col:
        both = replace_columns(both, {count_col: F.col(count_col) + F.least(F.col(count_col), F.lit(max_dups))})
    return _placed(both, draw, key, strategy)


def shuffle_rows(df: DataFrame, draw: Draw, key: str, batch: str | None = None, hex_digits: int = 3) -> DataFrame:
    """Random permutation as a dense column ``ord`` (per batch or over the table); nothing is sorted.

    ``key`` must be unique. Ranking runs in even hash slices, see ``hash_position``.
    """
    marked = ensure_audit(df).withColumn("_d", draw.digest("shuffle_rows", F.col(key)))
    out = hash_position(marked, "_d", [batch] if batch else [], "ord", hex_digits).drop("_d")
    return replace_columns(out, {AUDIT: noted(F.lit(True), F.lit("shuffle_rows()"))})


# --- arrays at any depth ------------------------------------------------------------------------

def rewrite_lists(col: Column, dtype: T.DataType, keys: tuple[Column, ...], path: str,
                  change: Callable[[Column, str, tuple[Column, ...]], Column],
                  fix_count: bool = False) -> Column:
    """Apply ``change(list, path, keys)`` to every list inside a value, inner lists first.

    Inside a list the element number joins the draw key. With ``fix_count`` a sibling ``count``
    field of a list is set to the new length.
    """
    if isinstance(dtype, T.ArrayType):
        inner = col
        if _has_list(dtype.elementType):
            inner = F.transform(col, lambda x, i: rewrite_lists(
                x, dtype.elementType, (*keys, i), path + "[]", change, fix_count))
        return change(inner, path, keys)
    if isinstance(dtype, T.StructType) and _has_list(dtype):
        new = {f.name: rewrite_lists(col[f.name], f.dataType, keys, f"{path}.{f.name}", change, fix_count)
               for f in dtype.fields}
        if fix_count and "count" in new:
            lists = [f.name for f in dtype.fields if isinstance(f.dataType, T.ArrayType)]
            if lists:
                kind = next(f.dataType for f in dtype.fields if f.name == "count")
                new["count"] = F.size(new[lists[0]]).cast(kind)
        return F.when(col.isNotNull(), F.struct(*[c.alias(n) for n, c in new.items()]))
    return col


def _has_list(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return True
    return isinstance(dtype, T.StructType) and any(_has_list(f.dataType) for f in dtype.fields)


def _list_fault(df, draw, key, op, p, hit, columns, change, fix_count=False):
    types = {f.name: f.dataType for f in df.schema.fields}
    names = columns or [n for n, t in types.items() if _has_list(t) and not n.startswith("_")]
    staged = ensure_audit(df).withColumn("_hit", hit_column(draw, op, key, p, hit))
    new = {n: F.when(F.col("_hit"), rewrite_lists(
        F.col(n), types[n], (F.col(key),), n, change, fix_count)).otherwise(F.col(n)) for n in names}
    new[AUDIT] = noted(F.col("_hit"), F.lit(f"{op}({','.join(names)})"))
    return replace_columns(staged, new, ("_hit",))


def duplicate_elements(df: DataFrame, draw: Draw, key: str, *, columns: list[str] | None = None,
                       p: float = 1.0, max_dups: int = 1, strategy: str = "adjacent",
                       hit: Column | None = None) -> DataFrame:
    """Copy ``min(max_dups, length)`` random elements of every nested list; ``count`` siblings follow."""

    def change(arr: Column, path: str, keys: tuple[Column, ...]) -> Column:
        def spots(n: Column, tag: str, extra: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max_dups))), lambda d: below(
                draw.u(f"duplicate_elements:{path}{tag}", *keys, d), n + extra))

        def adjacent(picked: Column) -> Column:
            return F.flatten(F.transform(arr, lambda x, i: F.array_repeat(
                x, F.size(F.filter(picked, lambda s: s == i)) + 1)))

        def spread(picked: Column) -> Column:
            homes = spots(F.size(arr), "#at", 1)
            own = F.transform(F.sequence(F.lit(0), F.size(arr) - 1),
                              lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(1).alias("own"), i.cast("bigint").alias("i")))
            new = F.zip_with(homes, picked, lambda a, s: F.struct(
                a.alias("at"), F.lit(0).alias("own"), s.alias("i")))
            return F.transform(F.array_sort(F.concat(own, new)), lambda e: F.get(arr, e["i"].cast("int")))

        body = spread if strategy == "random" else adjacent
        return F.when(F.size(arr) > 0, let(spots(F.size(arr), "#pick", 0), body)).otherwise(arr)

    return _list_fault(df, draw, key, "duplicate_elements", p, hit, columns, change, fix_count=True)


def shuffle_arrays(df: DataFrame, draw: Draw, key: str, *, columns: list[str] | None = None,
                   p: float = 1.0, hit: Column | None = None) -> DataFrame:
    """Permute every nested list of two or more elements: elements ordered by a hash of their number."""

    def change(arr: Column, path: str, keys: tuple[Column, ...]) -> Column:
        ranks = F.transform(F.sequence(F.lit(0), F.size(arr) - 1), lambda i: F.struct(
            draw.rank(f"shuffle_arrays:{path}", *keys, i).alias("h"), i.alias("i")))
        moved = F.transform(F.array_sort(ranks), lambda e: F.get(arr, e["i"]))
        return F.when(F.size(arr) > 1, moved).otherwise(arr)

    return _list_fault(df, draw, key, "shuffle_arrays", p, hit, columns, change)


# --- keys and nulls -----------------------------------------------------------------------------

def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of all struct fields, ``a`` and ``a.b``; audit columns and metadata are protected."""
    out = []
    for f in schema.fields:
        if f.name == META or (not prefix and f.name.startswith("_")):
            continue
        out.append(prefix + f.name)
        if isinstance(f.dataType, T.StructType):
            out += field_paths(f.dataType, prefix + f.name + ".")
    return out


def partial_load(df: DataFrame, draw: Draw, key: str, *, p: float = 0.1, min_keys: int = 1,
                 max_keys: int = 3, fields: list[str] | None = None, hit: Column | None = None) -> DataFrame:
    """Lose min..max keys (at any struct depth) of hit rows.

    A typed column cannot be absent, so a lost key reads null and is listed in ``_missing``: a null
    with an entry there is missing, one without is a real null.
    """
    paths = fields or [f for f in field_paths(df.schema) if f != key]
    hi = min(max_keys, len(paths))
    lo = min(min_keys, hi)
    count = F.lit(lo) + below(draw.u("partial_load#n", F.col(key)), hi - lo + 1)
    order = F.array_sort(F.array(*[
        F.struct(draw.rank(f"partial_load#{f}", F.col(key)).alias("h"), F.lit(f).alias("f")) for f in paths]))
    lost = F.array_sort(F.transform(F.slice(order, F.lit(1), count.cast("int")), lambda e: e["f"]))
    staged = (ensure_audit(df).withColumn("_hit", hit_column(draw, "partial_load", key, p, hit))
              .withColumn("_missing", F.when(F.col("_hit"), lost).otherwise(F.array().cast(NO_FAULTS))))

    def thin(col: Column, dtype: T.DataType, path: str) -> Column:
        if isinstance(dtype, T.StructType) and any(f.startswith(path + ".") for f in paths):
            inner = F.struct(*[thin(col[f.name], f.dataType, f"{path}.{f.name}").alias(f.name)
                               for f in dtype.fields])
            col = F.when(col.isNotNull(), inner)
        return F.when(~F.array_contains("_missing", path), col) if path in paths else col

    roots = {f.split(".")[0] for f in paths}
    new = {f.name: thin(F.col(f.name), f.dataType, f.name) for f in df.schema.fields if f.name in roots}
    label = F.concat(F.lit("partial_load(drop:"), F.array_join("_missing", ","), F.lit(")"))
    new[AUDIT] = noted(F.col("_hit"), label)
    return replace_columns(staged, new, ("_hit",))


def _leaf(path: str) -> Column:
    """Value (or list of values) a dotted path points to; ``a[].b`` reads ``a.b``."""
    return F.col(path.replace("[]", ""))


def _null_at(df: DataFrame, path: str, when: Column, element: Column) -> tuple[str, Column]:
    """(top column, expression) that nulls ``path``; ``a[].b`` nulls it in one list element."""
    if "[]" in path:
        arr, _, sub = path.partition("[]")
        sub = sub.lstrip(".")
        fixed = F.transform(arr, lambda x, i: F.when(
            i == element, x.withField(sub, F.lit(None)) if sub else F.lit(None)).otherwise(x))
        return arr, F.when(when, fixed).otherwise(F.col(arr))
    top, _, rest = path.partition(".")
    if rest:
        return top, F.when(when, F.col(top).withField(rest, F.lit(None))).otherwise(F.col(top))
    return top, F.when(~when, F.col(top))


def _filled(path: str) -> Column:
    if "[]" not in path:
        return _leaf(path).isNotNull()
    return F.size(F.filter(_leaf(path), lambda x: x.isNotNull())) > 0


def null_field(df: DataFrame, draw: Draw, key: str, *, fields: list[str] | None = None,
               per: str = "row", batch: str | None = None, p: float = 0.1,
               hit: Column | None = None) -> DataFrame:
    """Set one non-null leaf to null: in each hit row (``per="row"``) or in each whole batch.

    ``fields`` limits candidates: ``a``, ``a.b``, ``a[].b``; lists lose it in one drawn element. In batch
    mode each row offers its smallest-hash cell, a map-side minimum finds the batch's cell and only
    that one row per batch is joined back.
    """
    paths = fields or [f for f in field_paths(df.schema) if f != key and not any(
        g.startswith(f + ".") for g in field_paths(df.schema))]
    offers = F.array_compact(F.array(*[
        F.when(_filled(f), F.struct(draw.rank(f"null_field#{f}", F.col(key)).alias("h"), F.lit(f).alias("f")))
        for f in paths]))
    staged = ensure_audit(df).withColumn("_offer", F.array_min(offers))
    if per == "batch":
        by = [batch] if batch else []
        best = staged.where(F.col("_offer").isNotNull()).groupBy(*by).agg(
            F.min(F.struct(F.col("_offer.h").alias("h"), F.col(key).alias("k"))).alias("_best"))
        if by:
            staged = lookup_join(staged, best, by)
        else:
            staged = staged.withColumn("_best", best.scalar())
        won = (F.col("_best.k") == F.col(key)) & (F.col("_best.h") == F.col("_offer.h"))
        staged = staged.withColumn("_hit", F.coalesce(won, F.lit(False))).drop("_best")
    else:
        staged = staged.withColumn("_hit", hit_column(draw, "null_field", key, p, hit) & F.col("_offer").isNotNull())
    new: dict[str, Column] = {}
    for f in paths:
        element = F.lit(0)
        if "[]" in f:  # one of the elements that hold something
            full = F.filter(F.transform(_leaf(f), lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
            element = F.get(full, below(draw.u(f"null_field#{f}@", F.col(key)), F.size(full)).cast("int"))
        when = F.col("_hit") & (F.col("_offer.f") == f)
        top, expr = _null_at(df, f, when, element)
        if top in new:
            staged = replace_columns(staged, {top: new.pop(top)})
            top, expr = _null_at(df, f, when, element)
        new[top] = expr
    new[AUDIT] = noted(F.col("_hit"), F.concat(F.lit("null_field("), F.col("_offer.f"), F.lit(")")))
    return replace_columns(staged, new, ("_hit", "_offer"))


# --- text ---------------------------------------------------------------------------------------

def truncate_json(df: DataFrame, draw: Draw, key: str, *, p: float = 0.1, nodes: list[str] | None = None,
                  unit: str = "bytes", hit: Column | None = None) -> DataFrame:
    """Replace one node of a hit row by its JSON text, cut somewhere inside.

    Node ``""`` is the record itself: its text goes to ``_corrupt_record`` and all data columns read
    null, as a permissive JSON reader would return it. A string column keeps its text in place, another
    type reads null and its text goes to ``_fragments``.
    """
    cut = {"bytes": X.cut_bytes, "chars": X.cut_chars}[unit]
    types = {f.name: f.dataType for f in df.schema.fields}
    data = [c for c in df.columns if not c.startswith("_")]
    nodes = nodes if nodes is not None else ["", *[c for c in data if c != key]]
    u = draw.u("truncate_json#at", F.col(key))
    which = below(draw.u("truncate_json#node", F.col(key)), len(nodes))
    staged = (ensure_audit(df).withColumn("_hit", hit_column(draw, "truncate_json", key, p, hit))
              .withColumn("_node", F.when(F.col("_hit"), F.element_at(
                  F.array(*[F.lit(n) for n in nodes]), (which + 1).cast("int"))))
              .withColumn("_at", u))

    def text_of(c: str) -> Column:
        """JSON text of one value: the object around it is cut off."""
        wrapped = F.to_json(F.struct(F.col(f"`{c}`").alias("x")))
        return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)

    new: dict[str, Column] = {}
    loose = []
    for c in data:
        whole = F.col("_node") == ""
        if c == key:
            continue
        mine = F.col("_node") == c
        if c in nodes and isinstance(types[c], T.StringType):
            new[c] = F.when(mine & F.col(c).isNotNull(), cut(text_of(c), F.col("_at"))).when(
                whole, None).otherwise(F.col(c))
        elif c in nodes:
            loose.append(F.when(mine & F.col(c).isNotNull(), F.struct(
                F.lit(c).alias("k"), cut(text_of(c), F.col("_at")).alias("v"))))
            new[c] = F.when(~F.coalesce(mine | whole, F.lit(False)), F.col(c))
        else:
            new[c] = F.when(~F.coalesce(whole, F.lit(False)), F.col(c))
    if "" in nodes:
        record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in data]), {"ignoreNullFields": "false"})
        new["_corrupt_record"] = F.when(F.col("_node") == "", cut(record, F.col("_at")))
    if loose:
        new["_fragments"] = F.map_from_entries(F.array_compact(F.array(*loose)))
    new[AUDIT] = noted(F.col("_hit"), F.concat(F.lit("truncate_json("), F.col("_node"), F.lit(")")))
    return replace_columns(staged, new, ("_hit", "_node", "_at"))


def _pick_text(df: DataFrame, draw: Draw, key: str, op: str, columns: list[str], p: float,
               hit: Column | None, nonempty: bool) -> DataFrame:
    """Stage ``_hit`` and ``_pick``: the non-null string column this row loses."""
    usable = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & ((F.length(c) > 0) if nonempty else F.lit(True)), F.lit(c)) for c in columns]))
    staged = (ensure_audit(df).withColumn("_hit", hit_column(draw, op, key, p, hit))
              .withColumn("_names", usable))
    nth = below(draw.u(f"{op}#field", F.col(key)), F.size("_names")).cast("int")
    return (staged.withColumn("_pick", F.when(F.col("_hit"), F.get(F.col("_names"), nth)))
            .drop("_names", "_hit"))


def bloat(df: DataFrame, draw: Draw, key: str, *, columns: list[str] | None = None, p: float = 0.1,
          extra_kb: int = 32, strategy: str = "insert", hit: Column | None = None) -> DataFrame:
    """Grow one string of a hit row by ``extra_kb`` KiB: random printable text inserted at a random
    place, or its last word repeated. Candidates are all string columns, or ``columns``."""
    names = columns or string_columns(df, key)
    need = extra_kb * 1024
    staged = _pick_text(df, draw, key, "bloat", names, p, hit, nonempty=False)

    def grown(c: str) -> Column:
        s = F.col(c)
        pad = X.padding(draw, "bloat#pad", F.col(key), need)
        at = below(draw.u("bloat#at", F.col(key)), F.length(s) + 1)
        if strategy == "insert":
            return X.splice(s, at, 0, pad)
        return F.when(F.length(s) > 0, X.repeat_tail(s, need)).otherwise(pad)

    if need <= 0:
        return staged.drop("_pick")
    new = {c: F.when(F.col("_pick") == c, grown(c)).otherwise(F.col(c)) for c in names}
    label = F.concat(F.lit("bloat("), F.col("_pick"), F.lit(f",+{need} {strategy})"))
    new[AUDIT] = noted(F.col("_pick").isNotNull(), label)
    return replace_columns(staged, new, ("_pick",))


def corrupt_text(df: DataFrame, draw: Draw, key: str, *, columns: list[str] | None = None,
                 p: float = 0.1, hit: Column | None = None) -> DataFrame:
    """Change the value of one string of a hit row by one of nine strategies."""
    names = columns or string_columns(df, key)
    staged = _pick_text(df, draw, key, "corrupt_text", names, p, hit, nonempty=True)
    k = F.col(key)
    staged = staged.withColumns({
        "_how": F.when(F.col("_pick").isNotNull(), X.strategy_name(draw, "corrupt_text", k)),
        "_u1": draw.u("corrupt_text#pos", k), "_u2": draw.u("corrupt_text#chr", k)})
    new = {c: F.when(F.col("_pick") == c, X.corrupt(F.col(c), F.col("_how"), F.col("_u1"), F.col("_u2")))
           .otherwise(F.col(c)) for c in names}
    label = F.concat(F.lit("corrupt_text("), F.col("_pick"), F.lit(" "), F.col("_how"), F.lit(")"))
    new[AUDIT] = noted(F.col("_pick").isNotNull(), label)
    return replace_columns(staged, new, ("_pick", "_how", "_u1", "_u2"))


def corrupt_column_name(df: DataFrame, draw: Draw, columns: list[str] | None = None) -> DataFrame:
    """Typed-table form of ``json_faults.corrupt_key``: one column of the whole table is renamed."""
    names = columns or [c for c in df.columns if not c.startswith("_")]
    nth = df.sparkSession.range(1).select(
        below(draw.u("corrupt_key#key", F.lit("table")), len(names)).alias("i")).first()["i"]
    old = names[nth]
    made = df.sparkSession.range(1).select(X.corrupt(
        F.lit(old), X.strategy_name(draw, "corrupt_key", F.lit("table")),
        draw.u("corrupt_key#pos", F.lit("table")), draw.u("corrupt_key#chr", F.lit("table"))).alias("n")).first()["n"]
    return df.withColumnRenamed(old, made + L.ZERO_WIDTH[0] if made in df.columns else made)


# --- time ---------------------------------------------------------------------------------------

def _sign(draw: Draw, op: str, field: str, key: str, direction: str) -> Column:
    if direction == "future":
        return F.lit(1)
    return F.when(draw.u(f"{op}#sign:{field}", F.col(key)) < 0.5, F.lit(-1)).otherwise(F.lit(1))


def time_skew(df: DataFrame, draw: Draw, key: str, fields: list[str], *, max_skew_s: int,
              direction: str = "both", unit: str | None = None, p: float = 1.0,
              hit: Column | None = None) -> DataFrame:
    """Add a random 0..max to numeric time fields of hit rows, sign by direction.

    The number is added as it is, whatever the field's unit, unless ``unit`` (s, ms, us) says the
    skew is in seconds and must be scaled. ``both`` and ``past`` turn it negative half of the time.
    """
    scale = {None: 1, "s": 1, "ms": 1_000, "us": SECOND}[unit]
    staged = ensure_audit(df).withColumn("_hit", hit_column(draw, "time_skew", key, p, hit))
    new = {}
    for f in fields:
        skew = below(draw.u(f"time_skew#{f}", F.col(key)), max_skew_s + 1) * scale
        new[f] = F.when(F.col("_hit"), F.col(f) + skew * _sign(draw, "time_skew", f, key, direction)).otherwise(F.col(f))
    present = F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in fields], F.lit(False))
    new[AUDIT] = noted(F.col("_hit") & present, F.lit(f"time_skew({','.join(fields)})"))
    return replace_columns(staged, new, ("_hit",))


def write_time(old: Column, dtype: T.DataType, us: Column) -> Column:
    """Epoch microseconds written back in the encoding ``old`` uses."""
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(us)
    if isinstance(dtype, T.TimestampNTZType):
        return micros_to_clock(us)
    if isinstance(dtype, T.StringType):
        fraction = F.when(us % SECOND != 0, format_micros(us, "%Y-%m-%dT%H:%M:%S.%f")).otherwise(
            format_micros(us, "%Y-%m-%dT%H:%M:%S"))
        zoned = old.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        return (F.when(old.rlike(r"^-?\d{15,}$"), us.cast("string"))
                .when(old.rlike(r"^-?\d+$") & (F.length(old) != 8), F.floor(us / SECOND).cast("string"))
                .when(zoned, F.concat(fraction, F.lit("Z"))).otherwise(fraction))
    return F.when(F.abs(old) >= 10**15, us.cast(dtype)).otherwise(F.floor(us / SECOND).cast(dtype))


def read_time(col: Column, dtype: T.DataType) -> Column:
    """Epoch microseconds of a time value: timestamp, epoch s/us number, ISO or epoch text."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.TimestampNTZType):
        return clock_to_micros(col)
    if isinstance(dtype, T.StringType):
        number = col.try_cast("bigint")
        return (F.when(col.rlike(r"^-?\d{15,}$"), number)
                .when(col.rlike(r"^-?\d+$") & (F.length(col) != 8), number * SECOND)
                .otherwise(text_to_micros(col)))
    return F.when(F.abs(col) >= 10**15, col.cast("bigint")).otherwise((col * SECOND).cast("bigint"))


def time_skew_typed(df: DataFrame, draw: Draw, key: str, fields: list[str], *, max_skew_s: int,
                    direction: str = "both", p: float = 1.0, hit: Column | None = None) -> DataFrame:
    """Skew time fields by whole seconds below max and write them back in their own encoding (UTC)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    staged = ensure_audit(df).withColumn("_hit", hit_column(draw, "time_skew_typed", key, p, hit))
    read = {f"_us_{f}": read_time(F.col(f), types[f]) for f in fields}
    staged = staged.withColumns(read)
    new = {}
    for f in fields:
        skew = below(draw.u(f"time_skew_typed#{f}", F.col(key)), max_skew_s) * SECOND
        us = F.col(f"_us_{f}") + skew * _sign(draw, "time_skew_typed", f, key, direction)
        new[f] = F.when(F.col("_hit") & F.col(f"_us_{f}").isNotNull(), write_time(F.col(f), types[f], us)).otherwise(F.col(f))
    parsed = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in read], F.lit(False))
    new[AUDIT] = noted(F.col("_hit") & parsed, F.lit(f"time_skew_typed({','.join(fields)})"))
    return replace_columns(staged, new, ("_hit", *read))


def late_arrival(df: DataFrame, draw: Draw, key: str, ts: str, *, fields: list[str] | None = None,
                 min_elapsed_seconds: int = 3600, late_window_seconds: int = 3600, p: float = 0.1,
                 first_us: Column | int | None = None, current_us: Column | int | None = None,
                 hit: Column | None = None) -> DataFrame:
    """Give hit rows one random late time within the last window of the table's time range.

    Nothing happens while the range (``ts``: first to current) is shorter than ``min_elapsed``. The range is
    a scalar aggregate over one column, or is passed in (streams). All ``fields`` of a row get the
    same moment, each in its own encoding.
    """
    fields = fields or [ts]
    types = {f.name: f.dataType for f in df.schema.fields}
    if first_us is None or current_us is None:
        us = read_time(F.col(ts), types[ts])
        first = df.agg(F.min(us).alias("v")).scalar()
        current = df.agg(F.max(us).alias("v")).scalar()
    else:
        first, current = (v if isinstance(v, Column) else F.lit(v) for v in (first_us, current_us))
    staged = ensure_audit(df).withColumns({
        "_hit": hit_column(draw, "late_arrival", key, p, hit), "_first": first, "_now": current})
    elapsed = F.col("_now") - F.col("_first")
    window = F.least(F.lit(late_window_seconds * SECOND), elapsed)
    late = F.col("_now") - window + below(draw.u("late_arrival#at", F.col(key)), window + 1)
    staged = staged.withColumn("_late", F.when(
        F.col("_hit") & (elapsed >= min_elapsed_seconds * SECOND), late))
    new = {}
    for f in fields:
        filled = F.col("_late").isNotNull() & F.col(f).isNotNull()
        new[f] = F.when(filled, write_time(F.col(f), types[f], F.col("_late"))).otherwise(F.col(f))
    present = F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in fields], F.lit(False))
    new[AUDIT] = noted(F.col("_late").isNotNull() & present, F.lit(f"late_arrival({','.join(fields)})"))
    return replace_columns(staged, new, ("_hit", "_first", "_now", "_late"))


def time_columns(df: DataFrame, mode: str = "strict", share: float = 0.99) -> DataFrame:
    """Which columns hold times, and how: ``(column, encoding, share)``, one pass over the table.

    Strict asks that ``share`` of the non-null values parse to a moment in 1990..2100. Lenient accepts a
    column when any value parses: ISO text, any number a calendar can hold as seconds (booleans too),
    larger numbers as microseconds.
    """
    low, high = 631_152_000, 4_102_444_800  # fixed values: 1990-01-01 and 2100-01-01 in epoch seconds
    tests: list[tuple[str, str, Column]] = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            tests.append((f.name, "timestamp", c.isNotNull()))
        elif isinstance(t, T.StringType):
            tests.append((f.name, "iso", text_to_micros(c).isNotNull() & c.rlike(r"^\d{4}-?\d{2}-?\d{2}")))
            if mode == "lenient":
                tests += _number_tests(f.name, c.try_cast("double"), mode, low, high)
        elif isinstance(t, T.NumericType) or (mode == "lenient" and isinstance(t, T.BooleanType)):
            tests += _number_tests(f.name, c.cast("double"), mode, low, high)
    if not tests:
        raise ValueError("no column could hold a time")
    hits = [F.count_if(cond).alias(f"h{i}") for i, (_, _, cond) in enumerate(tests)]
    seen = [F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, (n, _, _) in enumerate(tests)]
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(e).alias("encoding"), (
        F.col(f"h{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("share"), F.lit(i).alias("rank"))
        for i, (n, e, _) in enumerate(tests)])
    found = df.agg(*hits, *seen).select(F.inline(rows))
    passed = found.where(F.col("share") >= share) if mode == "strict" else found.where(F.col("share") > 0)
    best = passed.groupBy("column").agg(F.min_by(F.struct("encoding", "share"), "rank").alias("_b"))
    return best.select("column", "_b.encoding", "_b.share")


def _number_tests(name, c, mode, low, high):
    if mode == "lenient":
        limit = 253_402_300_800  # fixed value: first second of year 10000
        return [(name, "epoch", F.abs(c) < limit), (name, "epoch_micro", F.abs(c) < limit * 1e6)]
    return [(name, enc, c.between(low * s, high * s))
            for enc, s in (("epoch", 1), ("epoch_milli", 1_000), ("epoch_micro", SECOND))]
