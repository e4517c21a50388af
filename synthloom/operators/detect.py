"""Detectors: checks on any table for the faults this library can inject."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.functions import lists as L
from synthloom.functions.jsons import MALFORMED, json_nodes, path_text
from synthloom.plans import spec as S
from synthloom.session import carried

BIG = "bigint"


def long_table(wide: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into rows, without another pass over the data."""
    structs = [F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows]
    return wide.select(F.inline(F.array(*structs)))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column and nested field: ``(path, nulls, total)``. Lists count their elements."""
    checks: list[tuple[str, Column, Column]] = []

    def walk(col: Column, dtype: T.DataType, path: str, listed: bool) -> None:
        if listed:
            checks.append((path, F.size(F.filter(col, lambda x: x.isNull())), F.size(col)))
        else:
            checks.append((path, col.isNull().cast("int"), F.lit(1)))
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(col[f.name], f.dataType, f"{path}.{f.name}", listed)
        elif isinstance(dtype, T.ArrayType):
            inner = F.flatten(F.filter(col, lambda x: x.isNotNull())) if listed else col
            walk(inner, dtype.elementType, path + "[]", True)

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name, False)
    zero = F.lit(0)
    wide = df.agg(*[F.coalesce(F.sum(F.coalesce(e, zero)), zero).cast(BIG).alias(f"{t}{i}")
                    for i, (_, n, k) in enumerate(checks) for t, e in (("n", n), ("t", k))])
    return long_table(wide, [{"path": F.lit(p), "nulls": F.col(f"n{i}"), "total": F.col(f"t{i}")}
                             for i, (p, _, _) in enumerate(checks)])


def key_profile(df: DataFrame, json_col: str) -> DataFrame:
    """How often each key (nested paths) is present in a JSON column; texts that are not JSON count without a path."""
    nodes = json_nodes(df.select(json_col), json_col, [])
    keys = nodes.where((F.col("kind") == MALFORMED) | ((F.size("steps") > 0) & F.element_at("steps", -1).isNotNull()))
    return keys.groupBy("steps").agg(F.count("*").alias("present")).select(path_text(F.col("steps")).alias("path"), "present")


def duplicate_rows_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Records that occur more than once: digest of their canonical JSON and number of copies."""
    names = sorted(cols or df.columns)
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])), 256)
    return (df.select(digest.alias("digest")).groupBy("digest")
            .agg(F.count("*").alias("copies")).where(F.col("copies") > 1))


def duplicate_elements_report(df: DataFrame, key: str, arr_col: str) -> DataFrame:
    """Rows whose list repeats an element."""
    size, distinct = F.size(arr_col), F.size(F.array_distinct(arr_col))
    return (df.select(key, size.cast(BIG).alias("elements"), distinct.cast(BIG).alias("distinct_elements"))
            .where(F.col("elements") > F.col("distinct_elements")))


def truncated_json_report(df: DataFrame, col: str) -> DataFrame:
    """Counts of texts that open like JSON without closing, and of texts that do not parse."""
    s = F.trim(F.col(col))
    opened = (F.startswith(s, F.lit("{")) & ~F.endswith(s, F.lit("}"))) | (
        F.startswith(s, F.lit("[")) & ~F.endswith(s, F.lit("]")))
    # inside brackets, text after the first value is an error instead of being ignored by the parser
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(col), F.lit("]")))
    one = F.variant_get(listed, "$[0]", "variant").isNotNull() & F.variant_get(listed, "$[1]", "variant").isNull()
    return df.agg(F.count(col).alias("texts"), F.count_if(opened).alias("unclosed"),
                  F.count_if(F.col(col).isNotNull() & ~F.coalesce(one, F.lit(False))).alias("invalid"))


# Suspicious character classes (Unicode code points).
SUSPECT = {
    "replacement": L.REPLACEMENT,
    "zero_width": L.chars(0x200B, 0x200C, 0x200D, 0x2060),
    "bidi": L.chars(0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E) + L.BIDI_ISOLATES,
    "bom": L.chars(0xFEFF),
    "odd_space": L.ODD_SPACES + L.chars(0x2007, 0x2008, 0x3000),
    "combining": L.COMBINING,
    "fullwidth": L.FULLWIDTH_ALNUM,
}
MIXED_SCRIPT = f"[A-Za-z][{L.HOMOGLYPH_TO}]|[{L.HOMOGLYPH_TO}][A-Za-z]"


def encoding_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column and class: rows and characters that look corrupted; whole texts, one pass.

    One regex pass drops what cannot be suspicious (everything up to U+02FF but the no-break space); the
    classes are then counted on what is left, which is a few characters for most Latin texts.
    """
    plain = "[\\x{0}-\\x{9F}\\x{A1}-\\x{2FF}]+"
    checks, kept = [], {}
    for i, c in enumerate(cols):
        s, odd = F.col(f"`{c}`"), F.col(f"_odd{i}")
        kept[f"_odd{i}"] = F.regexp_replace(s, plain, "")
        for name, chars in SUSPECT.items():
            checks.append((c, name, F.length(odd) - F.length(F.translate(odd, chars, ""))))
        foreign = F.length(F.translate(odd, L.HOMOGLYPH_TO, "")) < F.length(odd)
        checks.append((c, "mixed_script", F.when(foreign, F.regexp_count(s, F.lit(MIXED_SCRIPT))).otherwise(0)))
    staged = df.select(*[F.col(f"`{c}`") for c in cols]).withColumns(kept)
    wide = staged.select(*[e.alias(f"x{i}") for i, (_, _, e) in enumerate(checks)]).agg(
        *[F.count_if(F.col(f"x{i}") > 0).alias(f"r{i}") for i in range(len(checks))],
        *[F.coalesce(F.sum(f"x{i}"), F.lit(0)).cast(BIG).alias(f"c{i}") for i in range(len(checks))])
    return long_table(wide, [{"column": F.lit(c), "class": F.lit(n), "rows": F.col(f"r{i}"),
                              "chars": F.col(f"c{i}")} for i, (c, n, _) in enumerate(checks)])


def late_report(df: DataFrame, ts_us: str, arrival: str, key: str, width: int = 65_536) -> DataFrame:
    """Rows whose time is below the running maximum of their key, and by how much.

    ``arrival`` is a unique integer arrival order; the running maximum is carried across slices of it.
    """
    rows = carried(df.select(key, arrival, ts_us), [key], F.floor(F.col(arrival) / F.lit(width)),
                   {"_m": F.max(ts_us)}, {"_earlier": F.max("_m")})
    inside = W.partitionBy(key, "_slice").orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    seen = F.greatest(F.col("_earlier"), F.max(ts_us).over(inside))
    return (rows.withColumn("_seen", seen).where(F.col(ts_us) < F.col("_seen"))
            .select(key, arrival, ts_us, (F.col("_seen") - F.col(ts_us)).alias("late_by")))


def sequence_gap_report(df: DataFrame, user: str, seq: str, col: str, inc: int,
                        width: int = 65_536) -> DataFrame:
    """Rows whose step from the user's previous row differs from ``inc``."""
    rows = carried(df.select(user, seq, col), [user], F.floor(F.col(seq) / F.lit(width)),
                   {"_l": F.max_by(col, seq)}, {"_carry": F.last("_l")})
    inside = W.partitionBy(user, "_slice").orderBy(seq)
    first = F.row_number().over(inside) == 1
    previous = F.when(first, F.col("_carry")).otherwise(F.lag(col).over(inside))
    return (rows.withColumn("step", F.col(col) - previous)
            .where(F.col("step") != inc).select(user, seq, col, "step"))


def type_check(df: DataFrame, spec: Any) -> DataFrame:
    """Per spec field: rows, nulls, values of the wrong type, values outside the declared domain.

    Columns may be strings (a damaged feed): a value has the right type when it casts to it.
    """
    fields = S.load(spec)["fields"]
    checks = []
    for name, node in fields.items():
        while node["type"] in ("maybe", "object_or_null", "string_or_null"):
            node = node["child"]
        want = S.data_type(node).simpleString()
        c = F.col(f"`{name}`")
        typed = c if dict(df.dtypes)[name] == want else c.try_cast(want)
        domain = F.lit(True)
        if node["type"] in ("int", "float"):
            domain = typed.between(node["min"], node["max"])
            if node["type"] == "int":
                domain = domain & ((typed - node["min"]) % node["step"] == 0)
        elif node["type"] == "enum":
            domain = c.isin(node["values"])
        elif node.get("regex"):
            domain = c.rlike(node["regex"])
        checks.append((name, want, c, typed, domain))
    aggs = []
    for i, (_, _, c, typed, domain) in enumerate(checks):
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"),
                 F.count_if(c.isNotNull() & typed.isNull()).alias(f"t{i}"),
                 F.count_if(typed.isNotNull() & ~domain).alias(f"d{i}")]
    wide = df.agg(F.count("*").alias("rows"), *aggs)
    return long_table(wide, [{
        "field": F.lit(n), "type": F.lit(t), "rows": F.col("rows"), "nulls": F.col(f"n{i}"),
        "wrong_type": F.col(f"t{i}"), "out_of_domain": F.col(f"d{i}")} for i, (n, t, *_) in enumerate(checks)])


def distribution_check(df: DataFrame, spec: Any, tol: float = 0.02) -> DataFrame:
    """Observed against declared shares for enum weights, p_true and p_null, one pass."""
    checks = []
    for name, node in S.load(spec)["fields"].items():
        c = F.col(f"`{name}`")
        if node["type"] in ("maybe", "object_or_null", "string_or_null"):
            checks.append((name, "null", float(node["p_null"]), c.isNull(), F.lit(True)))
            node = node["child"]
        if node["type"] == "bool":
            checks.append((name, "true", float(node["p_true"]), c, c.isNotNull()))
        elif node["type"] == "enum":
            w = node.get("weights") or [1] * len(node["values"])
            checks += [(name, str(v), float(x) / float(sum(w)), c == v, c.isNotNull())
                       for v, x in zip(node["values"], w)]
    wide = df.agg(*[F.count_if(hit).alias(f"h{i}") for i, (*_, hit, _) in enumerate(checks)],
                  *[F.count_if(base).alias(f"b{i}") for i, (*_, base) in enumerate(checks)])
    rows = []
    for i, (name, value, share, _, _) in enumerate(checks):
        seen = F.col(f"h{i}") / F.nullif(F.col(f"b{i}"), F.lit(0))
        rows.append({"field": F.lit(name), "value": F.lit(value), "declared": F.lit(share),
                     "observed": seen, "ok": F.abs(seen - F.lit(share)) <= F.lit(tol)})
    return long_table(wide, rows)
