"""Measurement: counters, histograms, rates, quantiles and comparisons over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthloom.session import keys_join, persist_reliably

INF = float("inf")


def count_bucket(col: Column) -> Column:
    """Size class of a request count."""
    return (F.when(col <= 10, "1-10").when(col <= 100, "11-100").when(col <= 1000, "101-1000")
            .when(col <= 10000, "1001-10000").otherwise("10000+"))


def exact_sum(value: str | Column) -> Column:
    """Sum of numbers as a double that does not depend on the order of rows, where decimals can hold them.

    Twelve decimal places do for values from 1e-6 to 1e20; a group with smaller or larger ones is summed as doubles.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.abs(v)
    held = (F.coalesce(F.max(size), F.lit(0.0)) < 1e20) & (F.coalesce(F.min(F.when(size > 0, size)), F.lit(1.0)) >= 1e-6)
    decimals = F.try_sum(F.when(size < 1e20, v).try_cast("decimal(38,12)")).cast("double")
    return F.when(held, F.coalesce(decimals, F.sum(v))).otherwise(F.sum(v))


def labelled_counter(df: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    """Total per label set: the number of rows, or the sum of ``value``."""
    total = F.count("*") if value is None else exact_sum(value)
    return df.groupBy(*labels).agg(total.alias("total"))


def histogram(df: DataFrame, value: str, bounds: list[float], labels: list[str]) -> DataFrame:
    """Cumulative buckets ``le`` (with +Inf), count and sum per label set.

    Buckets are conditional counts of one aggregation, so rows are never multiplied.
    """
    edges = sorted(bounds)
    wide = df.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(edges)],
        F.count(value).alias("count"), exact_sum(value).alias("sum"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("bucket"))
                     for i, b in enumerate(edges)],
                   F.struct(F.lit(INF).alias("le"), F.col("count").alias("bucket")))
    return wide.select(*labels, "count", "sum", F.inline(rows))


def rate(df: DataFrame, ts: str, labels: list[str], window: str = "1 minute", value: str | None = None) -> DataFrame:
    """Per-second increase per window and label set."""
    total = F.count("*").cast("double") if value is None else exact_sum(value)
    w = F.window(F.col(ts).cast("timestamp"), window)
    agg = df.groupBy(w.alias("_w"), *labels).agg(total.alias("_total"))
    start, end = F.unix_micros("_w.start"), F.unix_micros("_w.end")
    return agg.select((start / 1_000_000).cast("bigint").alias("window_start"), *labels,
                      (F.col("_total") / ((end - start) / 1_000_000)).alias("per_second"))


def histogram_quantile(hist: DataFrame, qs: list[float], labels: list[str]) -> DataFrame:
    """Quantiles from cumulative buckets, linear inside the bucket; beyond the last bound, that bound.

    ``hist`` is the small output of ``histogram``: one row per label set and bound.
    """
    w = W.partitionBy(*labels).orderBy("le")
    edges = hist.select(*labels, "le", "bucket", "count",
                        F.coalesce(F.lag("bucket").over(w), F.lit(0)).alias("below"),
                        F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("lower"))
    quantiles = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    ranked = edges.select("*", quantiles).withColumn("rank", F.col("q") * F.col("count"))
    first = (F.col("bucket") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | (
        (F.col("rank") <= 0) & (F.col("below") == 0) & (F.col("bucket") > 0)))
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * (
        (F.col("rank") - F.col("below")) / (F.col("bucket") - F.col("below")))
    return (ranked.where(first & (F.col("count") > 0))
            .select(*labels, "q", F.when(F.col("le") == INF, F.col("lower")).otherwise(inside).alias("value")))


def error_ratio(df: DataFrame, ts: str, is_error: Column, window: str = "1 minute") -> DataFrame:
    """Percentage of rows that satisfy ``is_error`` per window."""
    w = F.window(F.col(ts).cast("timestamp"), window)
    agg = df.groupBy(w.alias("_w")).agg(F.count_if(is_error).alias("errors"), F.count("*").alias("rows"))
    return agg.select((F.unix_micros("_w.start") / 1_000_000).cast("bigint").alias("window_start"),
                      (F.col("errors") * F.lit(100.0) / F.col("rows")).alias("error_pct"))


def gauge_by_label(df: DataFrame, value: str, ts: str, series: list[str], label: str, tie: str) -> DataFrame:
    """Last value of each series, then maximum and sum per label."""
    last = df.groupBy(label, *series).agg(F.max_by(value, F.struct(ts, tie)).alias("_last"))
    return last.groupBy(label).agg(
        F.max("_last").alias("max_value"), exact_sum("_last").alias("sum_value"))


def order_bits(v: Column) -> Column:
    """A long that orders like the double ``v`` (NaN last, both zeros alike): its IEEE bits, read from its hexadecimal form."""
    text = F.format_string("%a", F.abs(v))  # 0x1.8p1; 0x0.8p-1022 below the normal range
    fraction = F.conv(F.rpad(F.substring(F.substring_index(text, "p", 1), 5, 13), 13, "0"), 16, 10).cast("bigint")
    exponent = F.substring_index(text, "p", -1).try_cast("bigint") + 1023
    small = F.substring(text, 3, 1) == "0"
    infinite = F.lit(2047 << 52)
    bits = (F.when(F.isnan(v), infinite + 1).when(F.abs(v) == INF, infinite)
            .when(small, fraction).otherwise(F.shiftleft(exponent, 52) + fraction))
    return F.when(v < 0, -bits - 1).otherwise(bits)


DIGIT = 16  # bits that one round of the selection decides


def percentiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact order statistics ``(by..., q, value)``: sorted[int(n*q)], the median as mean of the middle two.

    Radix selection: rows are counted by the highest 16 bits of their order, each wanted rank picks its prefix, and
    only rows with a picked prefix are counted by the next 16 bits, four times in all. Every round is one narrow
    scan with map-side counts, the first three run while the plan is built; nothing is sorted but the counts of one prefix (at most 65,536), so any table, any
    number of equal values and any group is answered. Nulls are not counted; groups without a value give no row.
    """
    by = by or []
    data = df.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    data = data.withColumn("_k", order_bits(F.col("v")))
    targets = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(i).alias("i")) for q in qs for i in (0, 1)])).alias("_t")
    rank = F.least(F.floor(F.col("n") * F.col("_t.q")), F.col("n") - 1)
    other = F.when(F.col("_t.q") == 0.5, F.floor((F.col("n") - 1) / 2)).otherwise(rank)

    def counted(rows: DataFrame, shift: int) -> DataFrame:
        return rows.groupBy(*by, F.shiftright("_k", shift).alias("_p")).agg(F.count("*").alias("_c"), F.min("v").alias("_v"))

    def picked(cells: DataFrame, of: list[str]) -> DataFrame:
        """Cells in which a rank lies, with the rank inside; each (of) holds the cells of one prefix."""
        upto = W.partitionBy(*by, *of).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
        placed = cells.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
        if not of:
            placed = placed.withColumn("n", F.sum("_c").over(W.partitionBy(*by))).select("*", targets)
            placed = placed.withColumn("_rank", F.when(F.col("_t.i") == 0, rank).otherwise(other)).select("*", "_t.q", "_t.i")
        hit = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
        return placed.where(hit).select(*by, "q", "i", "_p", (F.col("_rank") - F.col("_before")).alias("_rank"), "_v")

    shift = 64 - DIGIT
    found = picked(counted(data, shift), [])
    while shift:
        found = persist_reliably(found)  # a row per wanted rank; read twice below
        wanted = found.select(*by, "_p").distinct()
        inside = keys_join(data.withColumn("_p", F.shiftright("_k", shift)), wanted, [*by, "_p"], "left_semi")
        shift -= DIGIT
        cells = counted(inside, shift).withColumnRenamed("_p", "_next").withColumn("_p", F.shiftright("_next", DIGIT))
        both = keys_join(found.drop("_v"), cells, [*by, "_p"]).drop("_p").withColumnRenamed("_next", "_p")
        found = picked(both, ["q", "i"])
    return found.groupBy(*by, "q").agg(((F.max(F.when(F.col("i") == 0, F.col("_v"))) + F.max(F.when(F.col("i") == 1, F.col("_v")))) / 2).alias("value"))


def half_compare(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean of ``value`` in the first and second half of the time range, and the change in percent."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span = df.agg(F.struct(F.min(us).alias("a"), F.max(us).alias("b")).alias("s")).scalar()
    half = (us - span["a"]) * 2 < (span["b"] - span["a"])
    sides = df.select(F.col(value).alias("v"), half.alias("h")).agg(*[
        f.alias(n) for n, f in {
            "s1": exact_sum(F.when(F.col("h"), F.col("v"))), "n1": F.count_if(F.col("h")),
            "s2": exact_sum(F.when(~F.col("h"), F.col("v"))), "n2": F.count_if(~F.col("h"))}.items()])
    first, second = F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    return sides.select(first.alias("first_half"), second.alias("second_half"),
                        ((second - first) / first * 100.0).alias("change_pct"))


def share_summary(df: DataFrame, phase: Column, ok: Column) -> DataFrame:
    """Successes, failures and success percentage per phase."""
    agg = df.groupBy(phase.alias("phase")).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return agg.withColumn("success_pct", F.col("succeeded") * 100.0 / (F.col("succeeded") + F.col("failed")))


def top_type(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Most frequent label per key; a tie goes to the label seen first. Counts are built map-side."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(
        F.min_by(label, F.struct(-F.col("_n"), F.col("_first"))).alias("top"), F.max("_n").alias("times"))
