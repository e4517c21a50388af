"""JSON text as a long table of nodes, at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT, LIST = "map<string,variant>", "array<variant>"
STEPS = "array<string>"
PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"
MALFORMED = "malformed"


def json_nodes(df: DataFrame, json_col: str, keep: list[str], *, first_element: bool = False) -> DataFrame:
    """Every value inside a JSON column: ``(keep..., steps, kind, items, value VARIANT)``.

    ``steps`` are the keys down to the value, a null stands for a list's elements; the root has none. ``kind`` is
    ``object``, ``array`` or null for scalars, ``items`` a list's length. A text that does not parse gives one row with
    null steps and kind ``malformed``; a null text gives none. ``first_element`` follows only a list's first element.

    A document is parsed once; one expression walks it front by front until a front is empty, and a single unnest
    emits its nodes, so nothing is copied between levels and nothing is shuffled.
    """
    def node(steps: Column, v: Column) -> Column:
        return F.struct(steps.alias("steps"), v.alias("value"), v.try_cast(OBJECT).alias("m"), v.try_cast(LIST).alias("l"))

    def inside(n: Column) -> Column:
        items = F.slice(n["l"], 1, 1) if first_element else n["l"]
        return F.coalesce(
            F.transform(F.map_entries(n["m"]), lambda e: node(F.concat(n["steps"], F.array(e["key"])), e["value"])),
            F.transform(items, lambda x: node(F.concat(n["steps"], F.array(F.lit(None).cast("string"))), x)))

    def plain(n: Column) -> Column:
        kind = F.when(n["m"].isNotNull(), F.lit("object")).when(n["l"].isNotNull(), F.lit("array"))
        return F.struct(n["steps"].alias("steps"), kind.alias("kind"), F.size(n["l"]).alias("items"), n["value"].alias("value"))

    def deeper(seen: Column, _step: Column) -> Column:
        below = F.flatten(F.filter(F.transform(seen["front"], inside), lambda x: x.isNotNull()))
        return F.when(F.size(seen["front"]) == 0, seen).otherwise(F.struct(
            below.alias("front"), F.concat(seen["all"], F.transform(seen["front"], plain)).alias("all")))

    text = F.col(json_col)
    parsed = df.select(*keep, text.alias("_text"), F.try_parse_json(text).alias("_v")).where(F.col("_text").isNotNull())
    # no text is deeper than it has opening brackets; the fold stands still once a front is empty
    brackets = F.length("_text") - F.length(F.translate("_text", "{[", ""))
    nothing = F.array().cast(f"array<struct<steps:{STEPS},kind:string,items:int,value:variant>>")
    found = F.aggregate(F.sequence(F.lit(0), brackets),
                        F.struct(F.array(node(F.array().cast(STEPS), F.col("_v"))).alias("front"), nothing.alias("all")),
                        deeper, lambda seen: seen["all"])
    bad = F.array(F.struct(F.lit(None).cast(STEPS).alias("steps"), F.lit(MALFORMED).alias("kind"), F.lit(None).cast("int").alias("items"),
                           F.lit(None).cast("variant").alias("value")))
    return parsed.select(*keep, F.explode(F.when(F.col("_v").isNotNull(), found).otherwise(bad)).alias("_n")).select(
        *keep, "_n.steps", "_n.kind", F.when(F.col("_n.kind") == "array", F.col("_n.items")).alias("items"), "_n.value")


def path_text(steps: Column) -> Column:
    """Steps as text: ``a.b``, ``a[].b``; a key that is not a plain name stands in JSON quotes, so no two paths meet."""
    def step(key: Column) -> Column:
        quoted = F.to_json(F.array(key))
        return F.when(key.isNull(), F.lit("[]")).when(key.rlike(PLAIN_KEY), F.concat(F.lit("."), key)).otherwise(
            F.concat(F.lit("."), F.substring(quoted, F.lit(2), F.length(quoted) - 2)))
    return F.regexp_replace(F.array_join(F.transform(steps, step), ""), r"^\.", "")
