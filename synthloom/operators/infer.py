"""Spec inference from JSON text columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.functions.jsons import MALFORMED, json_nodes, path_text

DETAILS = ("digits", "email", "url")


def infer_sample(df: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """The first ``n`` records in order (top-k, no full sort); all of them by default."""
    return df if n is None else df.orderBy(order).limit(n)


def _typed(df: DataFrame, json_col: str, order: str, first_element: bool) -> DataFrame:
    """(order, steps, type, detail code, num, items) of every JSON value; codes and numbers keep aggregation hashed."""
    nodes = json_nodes(df.select(order, json_col), json_col, [order], first_element=first_element)
    # the parser trims 28.00 to DECIMAL(2,0), while whole numbers below 19 digits are BIGINT
    named = nodes.withColumn("kind", F.coalesce("kind", F.schema_of_variant("value")))
    kind = F.col("kind")
    typed = named.select(
        order, "steps", "value", "items", F.when(kind.isin("object", "array", MALFORMED), kind)
        .when(kind == "VOID", "maybe").when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int").when(kind.rlike(r"^DECIMAL\((19|[23]\d),0\)"), "int")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").otherwise("string").alias("type"))
    text = F.when(F.col("type") == "string", F.expr("try_cast(value as string)"))
    number = F.when(F.col("type").isin("int", "float"), F.expr("try_cast(value as double)"))
    detail = (F.when(text.rlike(r"^\p{Nd}+$"), 1).when(F.contains(text, F.lit("@")) & F.contains(text, F.lit(".")), 2)
              .when(text.rlike("^https?://"), 3))
    return typed.select(order, "steps", "type", detail.alias("detail"), number.alias("num"), F.col("items").cast("bigint").alias("items"))


def _detail(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, DETAILS)), code - 1)


def infer_value_type(df: DataFrame, json_col: str, order: str, first_element: bool = False) -> DataFrame:
    """Type of every JSON value: ``(order, path, type, detail, num, items)``.

    Null reads as ``maybe``; digit strings, e-mail addresses and URLs are told apart in ``detail``. ``num`` is a number's
    value, ``items`` a list's length. All elements of lists count, or only the first. A text that is not JSON is one
    row of type ``malformed`` without a path.
    """
    return _typed(df, json_col, order, first_element).select(
        order, path_text(F.col("steps")).alias("path"), "type", _detail(F.col("detail")).alias("detail"), "num", "items")


def infer_table(df: DataFrame, json_col: str, order: str, first_element: bool = False) -> DataFrame:
    """Merged type per path: the most frequent type (ties: first seen, then by name), its range, list lengths and number of types.

    One pass and one aggregation: all records and list elements merge into one associative record per (steps, type).
    Texts that are not JSON count in a row of type ``malformed`` without a path.
    """
    code, whole = F.coalesce("detail", F.lit(0)), dict(df.dtypes)[order] in ("bigint", "int")
    # the least detail of the first record; in one number where it can be, so that the aggregation stays hashed
    first = (F.pmod(F.min(F.col(order).cast("decimal(20,0)") * 4 + code), F.lit(4)).cast("int") if whole
             else F.min(F.struct(F.col(order).alias("o"), code.alias("d")))["d"])
    parts = _typed(df, json_col, order, first_element).groupBy("steps", "type").agg(
        F.count("*").alias("n"), F.min(order).alias("first_seen"), first.alias("d"),
        F.min("num").alias("min"), F.max("num").alias("max"), F.min("items").alias("min_items"), F.max("items").alias("max_items"))
    best = parts.groupBy("steps").agg(
        F.count("*").alias("kinds"),
        F.min_by(F.struct("type", "d", "n", "first_seen", "min", "max", "min_items", "max_items"),
                 F.struct(-F.col("n"), F.col("first_seen"), F.col("type"))).alias("b"))
    return best.select(path_text(F.col("steps")).alias("path"), "steps", "b.type", F.when(F.col("b.d") > 0, _detail(F.col("b.d"))).alias("detail"),
                       "b.n", "b.first_seen", "b.min", "b.max", "b.min_items", "b.max_items", "kinds")


def infer_spec(df: DataFrame, json_col: str, order: str, first_element: bool = False, max_paths: int = 20_000) -> dict[str, Any]:
    """A spec that can synthesise records like the samples. Only the path table reaches the driver.

    Of values of several types the most frequent one is taken. More than ``max_paths`` paths mean that keys are data;
    that is an error, as no spec can hold them.
    """
    rows = infer_table(df, json_col, order, first_element).where(F.col("steps").isNotNull()).limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"more than {max_paths} distinct paths: the keys look like data")
    nodes = {tuple(r["steps"]): r for r in rows}
    inside: dict[tuple, list[tuple]] = {}
    for steps in sorted(nodes, key=lambda s: (nodes[s]["first_seen"], [k or "" for k in s])):
        if steps:
            inside.setdefault(steps[:-1], []).append(steps)

    def build(steps: tuple) -> dict[str, Any]:
        r = nodes[steps]
        kind, below = r["type"], inside.get(steps, [])
        if kind == "maybe":
            return {"type": "maybe", "p_null": 0.5, "child": {"type": "string"}}
        if kind == "int":
            return {"type": "int", "min": int(r["min"]), "max": int(r["max"])}
        if kind == "float":
            return {"type": "float", "min": r["min"], "max": r["max"], "precision": 2}
        if kind == "array":
            child = [s for s in below if s[-1] is None]
            return {"type": "array", "min_items": r["min_items"], "max_items": r["max_items"],
                    "child": build(child[0]) if child else {"type": "string"}}
        if kind == "object":
            return {"type": "object", "fields": {s[-1]: build(s) for s in below if s[-1] is not None}}
        # digit strings keep their class; the length is bounded so that it can be generated
        text = {"digits": {"regex": r"^\d{1,12}$"}, "email": {"string_type": "email"},
                "url": {"string_type": "url"}}
        return {"type": kind, **text.get(r["detail"], {})}

    return build(()) if nodes else {"type": "object", "fields": {}}
