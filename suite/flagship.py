"""Flagship query: synthesise orders for real keys, link them to customers, damage them, audit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite.common import SEED, table
from suite.specs import FLAT
from synthloom.functions.draw import Draw
from synthloom.operators import audit, detect, faults, link
from synthloom.sources.synth import synth_over

SPEC = {"type": "object", "fields": {
    **FLAT["fields"], "c_custkey": {"type": "int", "depends_on_pool": "customers"},
    "c_mktsegment": {"type": "string", "depends_on_pool": "customers"}}}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = link.pool_build(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"])
    orders = synth_over(table(spark, sf_dir, "orders"), SPEC, "o_orderkey", SEED, keep=["o_orderkey"],
                        pools={"customers": pool})
    draw = Draw(SEED)
    damaged = faults.null_field(orders, draw, "o_orderkey", fields=["tier", "amount", "c_custkey"], p=0.1)
    damaged = faults.duplicate_rows(damaged, draw, "o_orderkey", p=0.05)
    data = damaged.select(*[c for c in damaged.columns if not c.startswith("_")])
    nulls = detect.null_profile(data).select(F.concat(F.lit("nulls:"), "path").alias("check"),
                                             F.col("nulls").alias("rows"), F.col("total"))
    hits = audit.fault_audit(damaged).select(F.concat(F.lit("fault:"), "op").alias("check"), "rows",
                                             F.col("executions").alias("total"))
    return nulls.unionByName(hits)
