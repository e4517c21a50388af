"""Which faults hit which row: a plan is drawn per row (or per batch) as an array column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthloom.functions.draw import Draw, below
from synthloom.operators import faults as ops
from synthloom.operators import json_faults as nested

PLAN = "_plan"

_OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "null_field": ops.null_field, "partial_load": ops.partial_load, "corrupt_text": ops.corrupt_text,
    "bloat": ops.bloat, "time_skew": ops.time_skew, "time_skew_typed": ops.time_skew_typed,
    "late_arrival": ops.late_arrival, "shuffle_arrays": ops.shuffle_arrays,
    "duplicate_elements": ops.duplicate_elements, "duplicate_rows": ops.duplicate_rows,
    "truncate_json": ops.truncate_json, "partial_load_json": nested.partial_load_json,
    "corrupt_key": nested.corrupt_key, "truncate_json_nodes": nested.truncate_json_nodes,
    "corrupt_json_text": nested.corrupt_json_text, "bloat_json": nested.bloat_json,
}


def register_fault(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add an operator ``fn(df, draw, key, *, hit, **params) -> df`` made of DataFrame operations."""
    _OPERATORS[name] = fn


@dataclass(frozen=True)
class FaultOp:
    name: str
    p: float = 0.0
    weight: float = 1.0
    enabled: bool = True
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class FaultPlan:
    """Enabled operators fire by their own p; min..max of those are drawn by weight, with repeats.

    ``max_faults`` caps operators that are not drift; ``forced`` names replace the draw altogether.
    ``ensure_at_least_one`` only raises ``min_ops`` to 1: rows where no operator fired stay clean.
    """

    ops: tuple[FaultOp, ...]
    min_ops: int = 0
    max_ops: int = 1
    max_faults: int | None = None
    ensure_at_least_one: bool = False
    forced: tuple[str, ...] = ()

    def candidates(self) -> list[FaultOp]:
        return [o for o in self.ops if o.enabled and o.p > 0]


def draw_plan(df: DataFrame, plan: FaultPlan, draw: Draw, key: str) -> DataFrame:
    """Add ``_plan``: names of the operators that apply to the row, drift first, duplicates merged."""
    none = F.array().cast(ops.NO_FAULTS)
    if plan.forced:
        known = [n for n in plan.forced if n in {o.name for o in plan.ops} or n in _OPERATORS]
        return df.withColumn(PLAN, F.array(*[F.lit(n) for n in known]).cast(ops.NO_FAULTS))
    cands = plan.candidates()
    low = max(plan.min_ops, 1) if plan.ensure_at_least_one else plan.min_ops
    if not cands or plan.max_ops == 0 or low > plan.max_ops:
        return df.withColumn(PLAN, none)
    k = F.col(key)
    staged = df.withColumns({f"_e{i}": draw.u(f"plan#{o.name}", k) < o.p for i, o in enumerate(cands)})
    cumulative, acc, fired = {}, F.lit(0.0), F.lit(0)
    for i, o in enumerate(cands):
        acc = (acc if i == 0 else F.col(f"_c{i - 1}")) + F.when(F.col(f"_e{i}"), F.lit(float(o.weight))).otherwise(0.0)
        staged = staged.withColumn(f"_c{i}", acc)
        fired = fired + F.col(f"_e{i}").cast("int")
    total = F.col(f"_c{len(cands) - 1}")
    count = F.least(F.lit(low) + below(draw.u("plan#k", k), plan.max_ops - low + 1), fired)
    staged = staged.withColumns({"_k": F.when(total > 0, count).otherwise(0), **{
        f"_r{j}": draw.u("plan#pick", k, F.lit(j)) * total for j in range(1, plan.max_ops + 1)}})

    def ticket(j: int) -> Column:
        """Name the j-th draw falls on: the first cumulative weight above it."""
        name = None
        for i, o in enumerate(cands):
            hit = F.col(f"_r{j}") < F.col(f"_c{i}")
            name = F.when(hit, o.name) if name is None else name.when(hit, o.name)
        return F.when(F.col("_k") >= j, name)

    tickets = [ticket(j) for j in range(1, plan.max_ops + 1)]
    if plan.max_faults is None or plan.max_faults >= plan.max_ops:
        names = F.array_compact(F.array(*tickets))
    else:
        marked = F.array_compact(F.array(*[F.when(t.isNotNull(), F.struct(
            draw.rank("plan#cut", k, F.lit(j)).alias("h"), t.alias("name"))) for j, t in enumerate(tickets, 1)]))
        drift = F.filter(marked, lambda t: F.contains(t["name"], F.lit("drift")))
        rest = F.filter(marked, lambda t: ~F.contains(t["name"], F.lit("drift")))
        cut = F.concat(drift, F.slice(F.array_sort(rest), 1, plan.max_faults))
        names = F.when(F.col("_k") > plan.max_faults, F.transform(cut, lambda t: t["name"])).otherwise(
            F.array_compact(F.array(*tickets)))
    temporary = [c for c in staged.columns if c not in df.columns]
    return staged.withColumn(PLAN, F.array_distinct(names)).drop(*temporary)


def apply_plan(df: DataFrame, plan: FaultPlan, draw: Draw, key: str, scope: str | None = None) -> DataFrame:
    """Draw the plan (per row, or per ``scope`` column, e.g. a batch) and run its operators in order.

    Every operator is guarded by the row's plan, so the whole plan is a chain of projections.
    Names without an operator are skipped.
    """
    planned = ops.ensure_audit(draw_plan(df, plan, draw, scope or key))
    wanted = plan.forced or [o.name for o in plan.candidates()]
    params = {o.name: o.params for o in plan.ops}
    ordered = sorted(dict.fromkeys(wanted), key=lambda n: "drift" not in n)
    for name in ordered:
        if name in _OPERATORS:
            hit: Column = F.array_contains(PLAN, name)
            planned = _OPERATORS[name](planned, draw, key, hit=hit, **params.get(name, {}))
    return planned
