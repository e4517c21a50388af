"""Linking operators: pools (foreign keys drawn from real parents) and bound attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.functions.draw import Draw, below
from synthloom.session import hash_position, lookup_join


def pool_build(df: DataFrame, anchor: str, siblings: list[str] | None = None) -> DataFrame:
    """Distinct (anchor + sibling) records; rows without an anchor are not stored."""
    siblings = [s for s in (siblings or []) if s in df.columns]
    return df.select(anchor, *siblings).where(F.col(anchor).isNotNull()).distinct()


def record_digest(cols: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])))


def pool_index(pool: DataFrame, hex_digits: int = 3) -> DataFrame:
    """Give each pool record a dense index ``_idx``, ordered by a digest of the record."""
    marked = pool.withColumn("_digest", record_digest(pool.columns))
    return hash_position(marked, "_digest", [], "_idx", hex_digits).drop("_digest")


def pool_join(child: DataFrame, pool: DataFrame, fields: list[str], key: str, draw: Draw,
              pool_name: str = "pool") -> DataFrame:
    """Each child row takes ``fields`` from one random pool record.

    The draw is an index, so this is an equi-join on evenly spread keys: small pools are broadcast by
    size, large ones shuffle without skew. An empty pool is an error, as is a missing field.
    """
    missing = [f for f in fields if f not in pool.columns]
    if missing:
        raise ValueError(f"pool {pool_name!r} has no field {missing}")
    records = pool if "_idx" in pool.columns else pool_index(pool)
    size = records.agg(F.count("*").alias("n")).scalar()
    checked = F.when(size > 0, size).otherwise(
        F.raise_error(F.lit(f"pool {pool_name!r} is empty")).cast("bigint"))
    drawn = child.withColumn("_idx", below(draw.u(f"pool:{pool_name}", F.col(key)), checked))
    joined = drawn.join(records.select("_idx", *fields), "_idx", "left")
    # the fields depend on the checked index, so an empty pool fails even if the join is optimised away
    return joined.select(*[F.col(f"`{c}`") for c in child.columns],
                         *[F.when(F.col("_idx") >= 0, F.col(f"`{f}`")).alias(f) for f in fields])


def pool_info(pool: DataFrame) -> DataFrame:
    """Pool size and one sample record (the one with the smallest digest), as JSON."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in pool.columns]), {"ignoreNullFields": "false"})
    return pool.select(record.alias("r")).agg(
        F.count("*").alias("size"), F.min_by("r", F.md5("r")).alias("sample"))


def bind_dictionary(existing: DataFrame, df: DataFrame, key: str, cols: list[str],
                    order: str) -> DataFrame:
    """Keep values already assigned to known keys, add each new key once (earliest row wins).

    A value stored as null counts as unassigned and is taken from the new rows, so first writers are
    found per column. Aggregation runs before the join; the dictionary holds one row per key.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}")
        for c in cols])
    joined = existing.select(key, *cols).join(first, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) for c in cols])


def bind_apply(df: DataFrame, dictionary: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Overwrite ``cols`` by the dictionary's values (one entry per key) for the row's key."""
    marked = dictionary.select(key, *[F.col(c).alias(f"_dict_{c}") for c in cols])
    joined = lookup_join(df, marked, [key])
    return joined.select(*[
        (F.coalesce(F.col(f"_dict_{c}"), F.col(f"`{c}`")).alias(c) if c in cols
         else F.col(f"`{c}`")) for c in df.columns])


def bind_cross(df: DataFrame, dictionary: DataFrame, anchor: str, cols: list[str],
               revision: int | None = None) -> DataFrame:
    """Take bound values from another spec's dictionary; a miss keeps the local value.

    ``dictionary`` has the anchor, the columns and optionally ``revision``; the pinned revision is
    used, else the latest one.
    """
    if "revision" in dictionary.columns:
        if revision is None:
            newest = dictionary.agg(F.max("revision").alias("r")).scalar()
            dictionary = dictionary.where(F.col("revision") == newest)
        else:
            dictionary = dictionary.where(F.col("revision") == revision)
    return bind_apply(df, dictionary, anchor, cols)


def fk_audit(child: DataFrame, parent: DataFrame, key: str, parent_key: str,
             siblings: dict[str, str] | None = None) -> DataFrame:
    """Rows, orphans and sibling mismatches of a foreign key.

    The child side is reduced to distinct (key, siblings) with counts first, so a hot key crosses
    the shuffle once per map task instead of once per row. ``siblings`` maps child to parent columns.
    """
    siblings = siblings or {}
    used = child.groupBy(F.col(key).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in siblings]).agg(
        F.count("*").alias("_rows"))
    known = parent.select(F.col(parent_key).alias("_k"), F.lit(True).alias("_hit"),
                          *[F.col(p).alias(f"_p_{c}") for c, p in siblings.items()])
    joined = used.join(known, "_k", "left")
    orphan = F.col("_k").isNotNull() & F.col("_hit").isNull()
    differs = F.lit(False)
    for c in siblings:
        differs = differs | ~F.col(f"_c_{c}").eqNullSafe(F.col(f"_p_{c}"))
    zero = F.lit(0).cast("bigint")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_rows")).otherwise(zero)), zero)

    return joined.agg(
        total(F.lit(True)).alias("rows"),
        total(orphan).alias("orphans"),
        total(F.col("_k").isNull()).alias("null_keys"),
        total(F.col("_hit").isNotNull() & differs).alias("mismatches"))
