"""Session helpers: reliable checkpoints and dense numbering that survives executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOCAL_BITS = 33  # row position bits of monotonically_increasing_id


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local session may fall back."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="synthloom-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared checkpoint folder, for tables and stream checkpoints."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def persist_reliably(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keys_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key, so no row is lost to it; keeps the left side's key columns."""
    other = {k: f"_right_{k}" for k in keys}
    both = left.join(right.withColumnsRenamed(other), [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in other.items()], how)
    return both if how in ("left_semi", "left_anti") else both.drop(*other.values())


def dense_position(df: DataFrame, order: list[Column], name: str = "seq",
                   partitions: int | None = None) -> DataFrame:
    """0-based dense position of every row in a global order, without a one-task window.

    Rows are range-partitioned and sorted, their (partition, offset) is written out once, and one
    count per partition (a table as small as the number of partitions) turns it into a dense number.
    ``order`` should be unique; ties that are equal in every column may be numbered either way.
    """
    ranged = (df.repartitionByRange(partitions, *order) if partitions
              else df.repartitionByRange(*order))
    placed = persist_reliably(
        ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", LOCAL_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    local = F.col("_at").bitwiseAND(F.lit(2**LOCAL_BITS - 1))
    return (placed.withColumn("_part", part)
            .join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + local)
            .drop("_part", "_start", "_at"))


def hash_position(df: DataFrame, digest: str, by: list[str], name: str, hex_digits: int = 3) -> DataFrame:
    """0-based dense rank of rows by a hex digest column, per group ``by``, in parallel slices.

    The first hex digits cut each group into even slices (hash values cannot be skewed), so even a
    group with most of the rows is ranked by many tasks. Slice sizes are counted first and give the
    offset of each slice. ``digest`` must be unique within a group.
    """
    sliced = df.withColumn("_slice", F.substring(F.col(digest), 1, hex_digits))
    sizes = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*by, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*by, "_slice").orderBy(digest)
    ranked = sliced.withColumn("_at", F.row_number().over(inside) - 1)
    return (keys_join(ranked, starts, [*by, "_slice"])
            .withColumn(name, F.col("_start") + F.col("_at"))
            .drop("_slice", "_start", "_at"))


def keyed_position(df: DataFrame, keys: list[str], order: str, name: str, width: int = 65_536) -> DataFrame:
    """0-based dense position of rows within ``keys``, ordered by a unique integer column.

    A key's rows are cut into slices of ``width`` consecutive order values, so no task ever sorts
    more than ``width`` rows of one key; slice sizes give the offsets.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / F.lit(width)))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_slice").orderBy(order)
    ranked = sliced.withColumn("_at", F.row_number().over(inside) - 1)
    return (keys_join(ranked, starts, [*keys, "_slice"])
            .withColumn(name, F.col("_start") + F.col("_at"))
            .drop("_slice", "_start", "_at"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """The first ``n`` rows per key, in two rounds.

    Round one keeps n rows per (key, salt), so a key that holds most of the table is worked on by
    ``salts`` tasks; round two sees at most n * salts rows of any key.
    """
    hashable = [f"`{c}`" for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(salts))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    last = W.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
            .withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n)
            .drop("_salt", "_rn"))


def carried(df: DataFrame, keys: list[str], slice_of: Column, aggs: dict[str, Column],
            carry: dict[str, Column]) -> DataFrame:
    """Split each key's rows into ordered slices and attach what earlier slices hand over.

    ``aggs`` summarise a slice; ``carry`` combines the summaries of all earlier slices of the key
    (aggregates over a window of summaries). A running computation then only needs a window inside
    (keys, ``_slice``), so a key with most of the rows is spread over as many tasks as it has slices.
    """
    sliced = df.withColumn("_slice", slice_of)
    sums = sliced.groupBy(*keys, "_slice").agg(*[e.alias(n) for n, e in aggs.items()])
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    handed = sums.select(*keys, "_slice", *[e.over(before).alias(n) for n, e in carry.items()])
    return keys_join(sliced, handed, [*keys, "_slice"])


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table with one row per key; rows without a key stay.

    A plain join reads either side once, so lookups can be chained: the plan grows by one join each. A key
    that holds most rows is split by adaptive execution's skew handling, which a left join allows for its
    left side; a small lookup is broadcast by its measured size.
    """
    return keys_join(df, lookup, keys, "left")


def islands(df: DataFrame, keys: list[str], order: str, ts_us: str, gap_us: int, width: int,
            name: str = "_island") -> DataFrame:
    """Mark runs of a key's rows without a gap above ``gap_us``: ``name`` is the order value a run starts at.

    Gaps are found against the previous row (handed over between slices of ``order``), then each row
    learns where its run starts, again slice by slice.
    """
    slice_of = F.floor(F.col(order) / F.lit(width))
    rows = carried(df, keys, slice_of, {"_l": F.max_by(ts_us, order)}, {"_before": F.last("_l")})
    inside = W.partitionBy(*keys, "_slice").orderBy(order)
    previous = F.when(F.row_number().over(inside) == 1, F.col("_before")).otherwise(F.lag(ts_us).over(inside))
    fresh = previous.isNull() | (F.col(ts_us) - previous > F.lit(gap_us))
    rows = rows.withColumn("_begin", F.when(fresh, F.col(order))).drop("_slice", "_before")
    rows = carried(rows, keys, slice_of, {"_b": F.max("_begin")}, {"_begun": F.max("_b")})
    upto = W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.max("_begin").over(upto), F.col("_begun"))).drop(
        "_slice", "_begun", "_begin")


def run_positions(df: DataFrame, keys: list[str], order: str, ts_us: str, gap_us: int, width: int,
                  seen: Column | None = None) -> DataFrame:
    """Add ``_run`` and ``_pos``: runs of a key's rows without a gap above ``gap_us``, and 0-based positions in them.

    A gap lies between a row's time and the last known time before it (``seen`` before the first row); rows without a
    time belong to the run they stand in. ``_run`` is the number of the row that begins the run, null for the first run
    where no gap begins it. Times, counts and run starts are handed over between slices, so no task holds a whole key.
    """
    slice_of = F.floor(F.col(order) / F.lit(width))
    known = F.when(F.col(ts_us).isNotNull(), F.col(order))
    rows = carried(df, keys, slice_of, {"_l": F.max_by(ts_us, known), "_n": F.count("*")},
                   {"_before": F.last("_l", ignorenulls=True), "_count": F.sum("_n")})
    inside = W.partitionBy(*keys, "_slice").orderBy(order)
    earlier = F.last(ts_us, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    previous = F.coalesce(earlier, "_before", *([seen] if seen is not None else []))
    number = F.coalesce("_count", F.lit(0)) + F.row_number().over(inside)
    rows = rows.withColumns({"_number": number, "_fresh": F.coalesce(F.col(ts_us) - previous > F.lit(gap_us), F.lit(False))})
    rows = rows.withColumn("_begin", F.when(F.col("_fresh"), F.col("_number")))
    rows = carried(rows.drop("_slice", "_before", "_count", "_fresh"), keys, slice_of, {"_b": F.max("_begin")}, {"_begun": F.max("_b")})
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    run = F.coalesce(F.max("_begin").over(upto), F.col("_begun"))
    return rows.withColumn("_run", run).withColumn("_pos", F.col("_number") - F.coalesce("_run", F.lit(1))).drop(
        "_slice", "_begin", "_begun", "_number")
