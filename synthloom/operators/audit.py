"""Reading the audit column: how often each fault ran and how many rows it touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthloom.operators.faults import AUDIT


def fault_audit(df: DataFrame) -> DataFrame:
    """Per operator: executions, rows affected and their share of all rows.

    The name is the text before the first parenthesis. Names are counted inside each row first; every row
    also emits one unnamed entry, so the total comes out of the same pass and the same small aggregate.
    """
    names = F.transform(AUDIT, lambda f: F.substring_index(f, "(", 1))
    per_row = F.transform(F.array_distinct("_n"), lambda n: F.struct(
        n.alias("op"), F.size(F.filter("_n", lambda m: m == n)).alias("times")))
    one = F.array(F.struct(F.lit("").alias("op"), F.lit(1).alias("times")))
    counts = (df.select(names.alias("_n")).select(F.inline(F.concat(one, per_row)))
              .groupBy("op").agg(F.sum("times").alias("executions"), F.count("*").alias("rows")))
    total = F.max(F.when(F.col("op") == "", F.col("rows"))).over(W.partitionBy())  # one row per operator
    return counts.withColumn("share", F.col("rows") / total).where(F.col("op") != "")
