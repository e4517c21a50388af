"""Drift on existing tables, layered synthesis and schema differences."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.functions.draw import Draw
from synthloom.functions.jsons import json_nodes, path_text
from synthloom.operators.infer import infer_table
from synthloom.plans import spec as S
from synthloom.plans.compile import add_fields
from synthloom.sources.synth import synth_over


def add_field(df: DataFrame, name: str, node: Any, draw: Draw, key: str, now: object = None) -> DataFrame:
    """Append a synthesised column."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return add_fields(df, S.load({"type": "object", "fields": {name: node}}), draw, key, key, now)


def drop_field(df: DataFrame, path: str) -> DataFrame:
    """Drop a column or a nested field ``a.b``."""
    top, _, rest = path.partition(".")
    return df.withColumn(top, F.col(top).dropFields(rest)) if rest else df.drop(top)


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a column; like in a spec, the renamed field moves to the end."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != old], F.col(f"`{old}`").alias(new))


def flatten_object(df: DataFrame, column: str) -> DataFrame:
    """Promote the fields of a struct column as ``column_child``."""
    inner = df.schema[column].dataType
    if not isinstance(inner, T.StructType):
        raise ValueError(f"{column!r} is not an object")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column],
                     *[F.col(column)[f.name].alias(f"{column}_{f.name}") for f in inner.fields])


def shift_numeric(df: DataFrame, column: str, delta: float | int) -> DataFrame:
    return df.withColumn(column, F.col(column) + F.lit(delta))


def shift_time(df: DataFrame, column: str, seconds: int) -> DataFrame:
    return df.withColumn(column, F.col(column) + F.make_interval(secs=F.lit(seconds)))


def shift_nulls(df: DataFrame, column: str, p: float, draw: Draw, key: str) -> DataFrame:
    """Null a share ``p`` of the values."""
    return df.withColumn(column, F.when(draw.u(f"{column}#drift_null", F.col(key)) >= p, F.col(column)))


def version_of(row: Column, intervals: list[tuple[int, int, str]]) -> Column:
    """Version serving a row: intervals are ordered and few, so a chain of comparisons does."""
    out = None
    for _, hi, version in intervals[:-1]:
        out = F.when(row < hi, version) if out is None else out.when(row < hi, version)
    last = F.lit(intervals[-1][2])
    return last if out is None else out.otherwise(last)


def synth_layers(df: DataFrame, specs: dict[str, Any], intervals: list[tuple[int, int, str]], key: str,
                 seed: int, **kw) -> DataFrame:
    """Rows made by different spec versions: each interval scans only its own key range.

    Fields a version lacks read null; ``_version`` tells which one made the row.
    """
    keep = list(kw.pop("keep", ()))
    parts = []
    for lo, hi, version in intervals:
        rows = df.where((F.col(key) >= lo) & (F.col(key) < hi))
        parts.append(synth_over(rows, specs[version], key, seed, keep=keep, **kw)
                     .withColumn("_version", F.lit(version)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences between two path tables ``(path, type)``: added, dropped, retyped, flattened.

    ``a.b`` gone and ``a_b`` new with the same type is one flattened path.
    """
    left = before.select("path", F.col("type").alias("old_type"))
    right = after.select("path", F.col("type").alias("new_type"))
    diff = left.join(right, "path", "full_outer").where(~F.col("old_type").eqNullSafe(F.col("new_type")))
    # a dropped a.b and an added a_b of one type meet in one group of this (schema-sized) table
    group = W.partitionBy(F.replace("path", F.lit("."), F.lit("_")), F.coalesce("old_type", "new_type"))
    nested = F.contains(F.col("path"), F.lit("."))
    source = F.max(F.when(F.col("new_type").isNull() & nested, F.col("path"))).over(group)
    target = F.max(F.when(F.col("old_type").isNull() & ~nested, F.col("path"))).over(group)
    marked = diff.withColumns({"_from": source, "_to": target})
    moved = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    change = (F.when(moved & (F.col("path") == F.col("_to")), "flattened").when(F.col("old_type").isNull(), "added")
              .when(F.col("new_type").isNull(), "dropped").otherwise("retyped"))
    return (marked.where(~(moved & (F.col("path") == F.col("_from"))))
            .select("path", change.alias("change"), "old_type", "new_type",
                    F.when(moved & (F.col("path") == F.col("_to")), F.col("_from")).alias("moved_from")))


SKETCH = 64  # cells of a value sketch


def value_sketch(df: DataFrame, json_col: str, draw: Draw) -> DataFrame:
    """(path, type, cell, least): of each path's scalar values per hash cell the least hash.

    A value's text is hashed, so equal values of two columns meet; cells merge by minimum, and a path has at most
    ``SKETCH`` of them whatever its number of rows.
    """
    nodes = json_nodes(df.select(json_col), json_col, []).where(F.col("kind").isNull())
    shape = F.schema_of_variant("value")
    kind = F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "bool").when(shape != "VOID", "number")
    hashed = nodes.select("steps", kind.alias("type"), draw.bits("sketch", F.col("value").cast("string")).alias("h")).where(F.col("type").isNotNull())
    cells = hashed.groupBy("steps", "type", F.pmod("h", F.lit(SKETCH)).alias("cell")).agg(F.min("h").alias("least"))
    return cells.select(path_text(F.col("steps")).alias("path"), "type", "cell", "least")


def column_renames(before: DataFrame, after: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(old_path, new_path, type, ratio) of renamed paths, from two value sketches.

    A path that is gone and one that is new are compared by the share of sketch cells in which their least values
    agree, an estimate of the overlap of their distinct values. Pairs of one type from ``threshold`` on that are each
    other's best (ties: by name) are renames, one to one. Both sides are as small as the schema.
    """
    def whole(cells: DataFrame) -> DataFrame:
        return cells.groupBy("path", "type").agg(F.count("*").alias("size"))

    # a path with any value on the other side was kept
    gone = before.join(after.select("path").distinct(), "path", "left_anti")
    new = after.join(before.select("path").distinct(), "path", "left_anti")
    agree = gone.select("type", "cell", "least", F.col("path").alias("old_path")).join(
        new.select("type", "cell", "least", F.col("path").alias("new_path")), ["type", "cell", "least"]).groupBy("type", "old_path", "new_path").agg(
        F.count("*").alias("same"))
    sized = (agree.join(whole(gone).select("type", F.col("path").alias("old_path"), F.col("size").alias("a")), ["type", "old_path"])
             .join(whole(new).select("type", F.col("path").alias("new_path"), F.col("size").alias("b")), ["type", "new_path"]))
    scored = sized.withColumn("ratio", F.col("same") / F.greatest("a", "b")).where(F.col("ratio") >= threshold)
    first = lambda by, name: F.row_number().over(W.partitionBy(by).orderBy(F.desc("ratio"), name))
    return (scored.withColumn("_o", first("old_path", "new_path")).withColumn("_n", first("new_path", "old_path"))
            .where((F.col("_o") == 1) & (F.col("_n") == 1)).select("old_path", "new_path", "type", "ratio"))


def schema_diff_rows(before: DataFrame, after: DataFrame, json_col: str, order: str, draw: Draw, threshold: float = 0.5) -> DataFrame:
    """``schema_diff`` of two JSON tables in which a drop and an add with the same values are one rename.

    More columns: ``moved_from`` also names a renamed path's old name, ``ratio`` how far the values agree.
    """
    plain = schema_diff(json_paths(before, json_col, order), json_paths(after, json_col, order))
    moves = column_renames(value_sketch(before, json_col, draw), value_sketch(after, json_col, draw), threshold)
    marked = plain.join(moves.select(F.col("new_path").alias("path"), F.col("old_path"), "ratio"), "path", "left").join(
        moves.select(F.col("old_path").alias("path"), F.lit(True).alias("_gone")), "path", "left")
    was = F.col("old_path").isNotNull() & (F.col("change") == "added")
    lost = F.coalesce("_gone", F.lit(False)) & (F.col("change") == "dropped")
    return marked.where(~lost).select(
        "path", F.when(was, "renamed").otherwise(F.col("change")).alias("change"), F.when(was, F.col("new_type")).otherwise(F.col("old_type")).alias("old_type"),
        "new_type", F.coalesce("moved_from", F.when(was, F.col("old_path"))).alias("moved_from"), F.when(was, F.col("ratio")).alias("ratio"))


def json_paths(df: DataFrame, json_col: str, order: str) -> DataFrame:
    """Path table of the records in a JSON column."""
    return infer_table(df, json_col, order).where((F.col("path") != "") & F.col("path").isNotNull()).select("path", "type")


def spec_paths(df: DataFrame, spec: Any) -> DataFrame:
    """Path table of a spec (``df`` lends its session)."""
    rows = [(p, n["type"]) for p, n in S.flatten(S.load(spec)).items()]
    return df.sparkSession.createDataFrame(rows, "path string, type string")
