"""Declarative specs: normal form, contract checks, path map and resulting Spark types."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from typing import Any

from pyspark.sql import types as T

# Type names, their aliases and the keys each accepts.
ALIASES = {
    "integer": "int", "double": "float", "number": "float", "boolean": "bool", "str": "string",
    "text": "string", "list": "array", "record": "object", "oneof": "one_of",
    "timestamp_stateful": "stateful_timestamp", "ts_stateful": "stateful_timestamp",
    "datetime_stateful": "stateful_datetime", "dt_stateful": "stateful_datetime",
}
KEYS = {
    "int": "min max step",
    "float": "min max precision",
    "bool": "p_true",
    "string": "string_type template regex n_type n_charset charset min_length max_length",
    "enum": "values weights",
    "timestamp": "start end depends_on",
    "datetime": "start end format tz time_start time_end depends_on",
    "stateful_timestamp": "start end increment",
    "stateful_datetime": "start end increment format tz",
    "array": "min_items max_items child",
    "object": "fields",
    "select": "options pick",
    "one_of": "choices weights",
    "maybe": "p_null child",
    "object_or_null": "p_null weights of child fields",
    "string_or_null": "p_null weights of",
}
FIELD_KEYS = set(
    "type required default pool depends_on_pool bound_to bound_to_schema bound_to_revision".split())
PICK_MODES = ("exact", "range", "at_least_one", "any")

_CUSTOM: dict[str, tuple[Any, T.DataType]] = {}


class SpecError(ValueError):
    """A spec breaks the contract."""


def register_generator(name: str, build, data_type: T.DataType) -> None:
    """Add a generator type: ``build(node, draw, path, key) -> Column`` (columns only, no UDF)."""
    _CUSTOM[name] = (build, data_type)


def custom_generator(name: str):
    return _CUSTOM.get(name)


def normalise(spec: Any, where: str = "") -> dict[str, Any]:
    """Return the checked normal form of a (possibly loose) spec node."""
    if isinstance(spec, str):
        spec = {"type": spec}
    if not isinstance(spec, Mapping):
        raise SpecError(f"{where or 'root'}: expected a mapping or a type name")
    node = dict(copy.deepcopy(dict(spec)))
    if "type" not in node:
        raise SpecError(f"{where or 'root'}: 'type' is missing")
    kind = node["type"] = ALIASES.get(node["type"], node["type"])
    if "linked_to" in node:
        node["bound_to"] = node.pop("linked_to")
    if node.get("pool") is True:
        node["pool"] = []
    elif node.get("pool") is False:
        node.pop("pool")
    if kind in _CUSTOM:
        return node
    if kind not in KEYS:
        raise SpecError(f"{where or 'root'}: unknown type {kind!r}")
    unknown = set(node) - set(KEYS[kind].split()) - FIELD_KEYS
    if unknown:
        raise SpecError(f"{where or 'root'}: unknown keys {sorted(unknown)} for {kind}")
    _NORMALISERS.get(kind, lambda n, w: None)(node, where)
    return node


def _numbers(node: dict, where: str) -> None:
    default_hi = 100 if node["type"] == "int" else 1.0
    lo, hi = node.setdefault("min", 0), node.setdefault("max", default_hi)
    if lo > hi:
        raise SpecError(f"{where}: min > max")
    if node["type"] == "int" and node.setdefault("step", 1) <= 0:
        raise SpecError(f"{where}: step must be positive")


def _weights(node: dict, count: int, where: str) -> None:
    w = node.get("weights")
    if w is None:
        return
    if len(w) != count:
        raise SpecError(f"{where}: {len(w)} weights for {count} choices")
    if any(x < 0 for x in w) or sum(w) <= 0:
        raise SpecError(f"{where}: weights must be >= 0 with a positive sum")


def _enum(node: dict, where: str) -> None:
    values = node.get("values")
    if not values:
        raise SpecError(f"{where}: enum needs values")
    flat = [next(iter(v.values())) if isinstance(v, Mapping) and len(v) == 1 and
            next(iter(v)) in ("value", "type") else v for v in values]
    node["values"] = flat
    _weights(node, len(flat), where)


def _probability(node: dict, key: str, default: float, where: str) -> None:
    if not 0 <= node.setdefault(key, default) <= 1:
        raise SpecError(f"{where}: {key} must be within [0, 1]")


def _array(node: dict, where: str) -> None:
    if "child" not in node:
        raise SpecError(f"{where}: array needs a child")
    lo = node["min_items"] = int(node.get("min_items") or 0)
    hi = node["max_items"] = int(lo if node.get("max_items") is None else node["max_items"])
    if lo < 0 or lo > hi:
        raise SpecError(f"{where}: need 0 <= min_items <= max_items")
    node["child"] = normalise(node["child"], where + "[]")


def _object(node: dict, where: str) -> None:
    fields = node.get("fields")
    if not fields:
        raise SpecError(f"{where or 'root'}: object needs fields")
    node["fields"] = {k: normalise(v, f"{where}.{k}".lstrip(".")) for k, v in fields.items()}
    _links(node["fields"], where)


def _links(fields: dict[str, dict], where: str) -> None:
    anchors = [k for k, v in fields.items() if "pool" in v]
    if len(anchors) > 1:
        raise SpecError(f"{where or 'root'}: only one pool anchor per spec, got {anchors}")
    for name, field in fields.items():
        if "depends_on_pool" in field and ("pool" in field or "bound_to" in field):
            raise SpecError(f"{name}: depends_on_pool excludes pool and bound_to")
        if "pool" in field:
            missing = set(field["pool"]) - set(fields)
            if missing:
                raise SpecError(f"{name}: pool siblings {sorted(missing)} do not exist")
        for ref in (field.get("bound_to"), field.get("depends_on")):
            if ref is not None and ref not in fields:
                raise SpecError(f"{name}: refers to unknown field {ref!r}")


def _select(node: dict, where: str) -> None:
    options = node.get("options")
    if not isinstance(options, Mapping) or not options:
        raise SpecError(f"{where}: select needs an options mapping")
    out = {}
    for key, conf in options.items():
        if not isinstance(conf, Mapping) or "of" not in conf:
            raise SpecError(f"{where}.{key}: option needs 'of'")
        out[key] = {"of": normalise(conf["of"], f"{where}.{key}"),
                    "required": bool(conf.get("required"))}
    node["options"] = out
    pick = node["pick"] = dict(node.get("pick") or {})
    mode = pick.setdefault("mode", "any")
    if mode not in PICK_MODES:
        raise SpecError(f"{where}: pick.mode must be one of {PICK_MODES}")
    if mode == "exact" and pick.get("min") is None:
        raise SpecError(f"{where}: exact needs pick.min")
    if mode == "range" and (pick.get("min") is None or pick.get("max") is None):
        raise SpecError(f"{where}: range needs pick.min and pick.max")
    if any(w < 0 for w in (pick.get("weights") or {}).values()):
        raise SpecError(f"{where}: weights must be non-negative")


def _one_of(node: dict, where: str) -> None:
    if not node.get("choices"):
        raise SpecError(f"{where}: one_of needs choices")
    node["choices"] = [normalise(c, f"{where}|{i}") for i, c in enumerate(node["choices"])]
    _weights(node, len(node["choices"]), where)


def _maybe(node: dict, where: str) -> None:
    if "child" not in node:
        raise SpecError(f"{where}: maybe needs a child")
    _probability(node, "p_null", 0.1, where)
    node["child"] = normalise(node["child"], where + ".?")


def _nullable_pair(node: dict, where: str) -> None:
    """``object_or_null`` / ``string_or_null``: p_null or two weights (value, null)."""
    child = node.pop("of", None) or node.pop("child", None)
    if child is None and "fields" in node:
        child = {"type": "object", "fields": node.pop("fields")}
    if child is None and node["type"] == "string_or_null":
        child = {"type": "string"}
    if child is None:
        raise SpecError(f"{where}: {node['type']} needs a child")
    weights = node.pop("weights", None)
    if weights is not None:
        if len(weights) != 2 or min(weights) < 0 or sum(weights) <= 0:
            raise SpecError(f"{where}: weights must be two non-negative numbers")
        node["p_null"] = 1.0 - weights[0] / sum(weights)
    _probability(node, "p_null", 0.5 if node["type"] == "string_or_null" else 0.1, where)
    node["child"] = normalise(child, where + ".?")


_NORMALISERS = {
    "int": _numbers, "float": _numbers, "enum": _enum, "array": _array, "object": _object,
    "select": _select, "one_of": _one_of, "maybe": _maybe,
    "bool": lambda n, w: _probability(n, "p_true", 0.5, w),
    "object_or_null": _nullable_pair, "string_or_null": _nullable_pair,
}


def load(spec: Any) -> dict[str, Any]:
    """Normalise a whole spec; the root must be an object."""
    node = normalise(spec)
    if node["type"] != "object":
        raise SpecError("the root of a spec must be an object")
    return node


def flatten(node: dict[str, Any], path: str = "") -> dict[str, dict[str, Any]]:
    """Path map of a normalised spec: ``a.b``, ``a[]``, ``a|0``, ``a.?``."""
    out = {path: node} if path else {}
    for sub, child in children(node, path):
        out.update(flatten(child, sub))
    return out


def children(node: dict[str, Any], path: str):
    kind = node["type"]
    if kind == "object":
        yield from ((f"{path}.{k}".lstrip("."), v) for k, v in node["fields"].items())
    elif kind == "array":
        yield path + "[]", node["child"]
    elif kind == "one_of":
        yield from ((f"{path}|{i}", c) for i, c in enumerate(node["choices"]))
    elif kind == "select":
        yield from ((f"{path}.{k}", o["of"]) for k, o in node["options"].items())
    elif kind in ("maybe", "object_or_null", "string_or_null"):
        yield path + ".?", node["child"]


def field_levels(fields: dict[str, dict]) -> list[list[str]]:
    """Fields in dependency order: each level needs only earlier levels. Cycles are an error."""
    needs = {
        k: {r for r in (v.get("depends_on"), v.get("bound_to") if "pool" not in v else None) if r}
        for k, v in fields.items()}
    done: set[str] = set()
    levels: list[list[str]] = []
    while len(done) < len(fields):
        ready = [k for k in fields if k not in done and needs[k] <= done]
        if not ready:
            raise SpecError(f"cyclic references among {sorted(set(fields) - done)}")
        levels.append(ready)
        done |= set(ready)
    return levels


def data_type(node: dict[str, Any]) -> T.DataType:
    """Spark type a node compiles to."""
    kind = node["type"]
    if kind in _CUSTOM:
        return _CUSTOM[kind][1]
    if kind in ("int", "timestamp", "stateful_timestamp"):
        return T.LongType()
    if kind == "float":
        return T.DoubleType()
    if kind == "bool":
        return T.BooleanType()
    if kind in ("string", "datetime", "stateful_datetime"):
        return T.StringType()
    if kind == "enum":
        return unify([literal_type(v) for v in node["values"]])
    if kind == "array":
        return T.ArrayType(data_type(node["child"]))
    if kind == "object":
        return T.StructType([T.StructField(k, data_type(v)) for k, v in node["fields"].items()])
    if kind == "select":
        return T.StructType(
            [T.StructField(k, data_type(o["of"])) for k, o in node["options"].items()])
    if kind == "one_of":
        return unify([data_type(c) for c in node["choices"]])
    return data_type(node["child"])


def literal_type(v: Any) -> T.DataType:
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.LongType()
    if isinstance(v, float):
        return T.DoubleType()
    return T.StringType()


def unify(types: list[T.DataType]) -> T.DataType:
    """Common type of alternatives: equal -> same, structs -> merged, otherwise VARIANT."""
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(isinstance(t, T.StructType) for t in types):
        merged: dict[str, list[T.DataType]] = {}
        for t in types:
            for f in t.fields:
                merged.setdefault(f.name, []).append(f.dataType)
        return T.StructType([T.StructField(k, unify(v)) for k, v in merged.items()])
    return T.VariantType()
