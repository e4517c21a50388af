"""Drift of specs as data: a plan of edit records, and one function that applies them.

Planning draws what changes, from hashes of (seed, place), so a plan can be replayed, stored and read. Amounts
are given as intervals ``(lo, hi)``; an edit holds the amount that was drawn. Data that shows the drift is
synthesised at scale from the edited spec.
"""

from __future__ import annotations

import copy
import datetime as dt
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from synthloom.functions.times import SECOND, to_micros
from synthloom.plans import spec as S

Interval = tuple[float, float]
STRUCTURE = ("add", "drop", "rename", "flatten")
# Nodes that "add" may draw; any other table of nodes can be given.
TEMPLATES: dict[str, Any] = {
    "word": {"type": "string", "string_type": "word"}, "count": {"type": "int", "min": 0, "max": 1000},
    "ratio": {"type": "float", "min": 0.0, "max": 1.0, "precision": 4}, "flag": {"type": "bool"}}


@dataclass(frozen=True)
class Edit:
    """One change: what is done to the node at ``path``, and the values it needs."""

    action: str
    path: tuple[str | int, ...]
    value: Any = None


def unit(seed: int | str, *place: object) -> float:
    """The draw of a place: 52 bits of md5, as in the portable column draws."""
    return int(hashlib.md5("|".join(map(str, (seed, *place))).encode()).hexdigest()[:13], 16) / 2**52


def inside(interval: Interval, seed: int | str, *place: object) -> float:
    lo, hi = sorted(interval)
    return lo + unit(seed, *place) * (hi - lo)


def within(x: float, lo: float, hi: float) -> float:
    return min(hi, max(lo, x))


# --- structure ----------------------------------------------------------------------------------

def plan_structure(spec: Any, seed: int, actions: Iterable[str] = STRUCTURE, steps: int = 1,
                   keep: Iterable[str] = (), templates: dict[str, Any] = TEMPLATES) -> list[Edit]:
    """``steps`` edits of the root record. New names carry the step and a digest, so they are unique.

    Fields in ``keep`` are never dropped, renamed or flattened; a step with nothing to act on gives no edit.
    """
    node, plan, actions, keep = S.load(spec), [], tuple(actions), set(keep)
    for step in range(steps):
        action = actions[int(unit(seed, step) * len(actions))]
        free = sorted(k for k in node["fields"] if k not in keep)
        if action == "flatten":
            free = [k for k in free if node["fields"][k]["type"] == "object"]
        if action == "add":
            kind = sorted(templates)[int(unit(seed, step, "node") * len(templates))]
            edit = Edit("add", (_fresh(kind, seed, step),), copy.deepcopy(templates[kind]))
        elif not free or action == "drop" and len(free) < 2:
            continue
        else:
            name = free[int(unit(seed, step, "field") * len(free))]
            edit = Edit(action, (name,), _fresh(name, seed, step) if action == "rename" else None)
        plan.append(edit)
        node = apply_edits(node, [edit])
    return plan


def _fresh(stem: str, seed: int | str, step: int) -> str:
    return f"{stem}_{step}{hashlib.md5(f'{seed}|{step}|name'.encode()).hexdigest()[:6]}"


def _point_to(fields: dict, old: str, new: str | None) -> dict:
    """References to a field follow its new name, or go with it."""
    out = {}
    for name, node in fields.items():
        node = dict(node)
        for link in ("depends_on", "bound_to"):
            if node.get(link) == old:
                node.pop(link)
                node |= {link: new} if new else {}
        if node.get("pool"):
            node["pool"] = [new if s == old else s for s in node["pool"] if s != old or new]
        out[name] = node
    return out


def _restructure(fields: dict, edit: Edit) -> dict:
    (name,) = edit.path
    if edit.action == "add":
        return {**fields, name: S.normalise(edit.value)}
    if edit.action == "drop":
        return _point_to({k: v for k, v in fields.items() if k != name}, name, None)
    if edit.action == "rename":
        return _point_to({edit.value if k == name else k: v for k, v in fields.items()}, name, edit.value)
    rest = {k: v for k, v in fields.items() if k != name}
    for child, node in fields[name]["fields"].items():
        target = f"{name}_{child}"
        while target in rest:
            target += "_"
        rest[target] = node
    return rest


# --- values -------------------------------------------------------------------------------------

def _numeric(node: dict, want: dict, seed, path) -> Iterator[Edit]:
    """Move both ends of a range, by an amount (``shift``) or a share of the range (``share``)."""
    span = max(1, node["max"] - node["min"])
    by = inside(want["shift"], seed, *path, "shift") if "shift" in want else span * inside(want.get("share", (-0.2, 0.2)), seed, *path, "shift")
    if node["type"] == "int":
        by = round(by) or (1 if by >= 0 else -1)  # a whole step, or nothing would drift
    yield Edit("set", path, {"min": node["min"] + by, "max": node["max"] + by})
    unit_key, least = ("step", 1) if node["type"] == "int" else ("precision", 0)
    if unit_key in want and node.get(unit_key) is not None:
        yield Edit("set", path, {unit_key: max(least, node[unit_key] + round(inside(want[unit_key], seed, *path, unit_key)))})


def _time(node: dict, want: dict, seed, path) -> Iterator[Edit]:
    """Move a window by seconds (``shift``) or a share of its length (``share``)."""
    ends = {k: to_micros(node[k]) for k in ("start", "end") if node.get(k) is not None}
    if ends:
        length = (max(ends.values()) - min(ends.values())) / SECOND or 60.0
        by = inside(want["shift"], seed, *path, "shift") if "shift" in want else length * inside(want.get("share", (-0.1, 0.1)), seed, *path, "shift")
        zero, move = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), round(by * SECOND)
        yield Edit("set", path, {k: (zero + dt.timedelta(microseconds=v + move)).isoformat() for k, v in ends.items()})


def _weights(node: dict, want: dict, seed, path) -> Iterator[Edit]:
    """Put an enum's values in another order, then move weight between two choices (``move``) or give one all (``only``).

    Weights are shares of 1 before they move.
    """
    items = "values" if node["type"] == "enum" else "choices"
    n, weights = len(node[items]), node.get("weights")
    if n < 2:
        return
    if node["type"] == "enum" and want.get("order", True):
        order = sorted(range(n), key=lambda i: unit(seed, *path, "order", i))
        weights = weights and [weights[i] for i in order]
        yield Edit("set", path, {"values": [node["values"][i] for i in order], **({"weights": weights} if weights else {})})
    if weights:
        shares = [x / sum(weights) for x in weights]
        at = int(unit(seed, *path, "to") * n)
        if want.get("only"):
            shares = [float(i == at) for i in range(n)]
        else:
            other = (at + 1 + int(unit(seed, *path, "from") * (n - 1))) % n
            by = inside(want.get("move", (-0.1, 0.1)), seed, *path, "move")
            shares[at], shares[other] = within(shares[at] + by, 0, 1), within(shares[other] - by, 0, 1)
            shares = [round(x / (sum(shares) or 1), 4) for x in shares]
        yield Edit("set", path, {"weights": shares})


def _nulls(node: dict, want: dict, seed, path) -> Iterator[Edit]:
    """Move the null share of a node that may be null."""
    p = within(node["p_null"] + inside(want.get("move", (-0.1, 0.1)), seed, *path, "null"), 0, 1)
    yield Edit("set", path, {"p_null": p})


def _length(node: dict, want: dict, seed, path) -> Iterator[Edit]:
    """Move both ends of a list's length."""
    by = round(inside(want.get("move", (-1, 1)), seed, *path, "length"))
    least = max(0, node["min_items"] + by)
    yield Edit("set", path, {"min_items": least, "max_items": max(least, node["max_items"] + by)})


def _options(node: dict, want: dict, seed, path) -> Iterator[Edit]:
    """Put a select's options in another order and move how many are picked."""
    names = sorted(node["options"], key=lambda k: unit(seed, *path, "order", k))
    most = sum(not o["required"] for o in node["options"].values())
    by = round(inside(want.get("move", (-1, 1)), seed, *path, "pick"))
    pick = {k: int(within(v + by, 0, most)) if k in ("min", "max") and v is not None else v for k, v in node["pick"].items()}
    yield Edit("set", path, {"options": {k: node["options"][k] for k in names}, "pick": pick})


PLANNERS = {"int": _numeric, "float": _numeric, "timestamp": _time, "datetime": _time, "enum": _weights, "one_of": _weights,
            "maybe": _nulls, "object_or_null": _nulls, "string_or_null": _nulls, "array": _length, "select": _options}
MAY_BE_NULL = frozenset({"int", "float", "string", "timestamp"})


def plan_values(spec: Any, seed: int, settings: dict[str, dict] | None = None, fields: Iterable[str] | None = None,
                depth: int = 2) -> list[Edit]:
    """Edits of value ranges, weights, null shares and shapes, by settings per node type.

    ``{"nulls": (lo, hi)}`` lets values of a type be null with a share from that interval. ``depth`` levels of
    children (elements, one branch of a choice, values that may be null) are drawn into the plan. Types can be
    added to ``PLANNERS``: ``planner(node, settings, seed, path)`` yields edits.
    """
    root, settings = S.load(spec), settings or {}

    def visit(node: dict, path: tuple, left: int) -> Iterator[Edit]:
        want = settings.get(node["type"], {})
        if node["type"] in PLANNERS:
            yield from PLANNERS[node["type"]](node, want, seed, path)
        if left > 1 and "child" in node:
            yield from visit(node["child"], (*path, "child"), left - 1)
        elif left > 1 and node["type"] == "one_of":
            i = int(unit(seed, *path, "branch") * len(node["choices"]))
            yield from visit(node["choices"][i], (*path, "choices", i), left - 1)
        if "nulls" in want and node["type"] in MAY_BE_NULL:
            yield Edit("nullable", path, within(inside(want["nulls"], seed, *path, "nulls"), 0, 1))

    return [e for name in (fields or root["fields"]) for e in visit(root["fields"][name], (name,), depth)]


def apply_edits(spec: Any, edits: Iterable[Edit]) -> dict:
    """The spec with all edits made, in order."""
    root = copy.deepcopy(S.load(spec))
    for e in edits:
        if e.action in STRUCTURE:
            root["fields"] = _restructure(root["fields"], e)
            continue
        holder, key = root["fields"], e.path[0]
        for step in e.path[1:]:
            holder, key = holder[key], step
        if e.action == "set":
            holder[key] = {**holder[key], **copy.deepcopy(e.value)}
        elif e.action == "nullable":
            inner = holder[key]
            outer = {k: v for k, v in inner.items() if k in S.FIELD_KEYS - {"type"}}
            holder[key] = {"type": "maybe", "p_null": e.value, "child": {k: v for k, v in inner.items() if k not in outer}, **outer}
        else:
            raise ValueError(f"unknown edit {e.action!r}")
    return root


# --- revisions over rows ------------------------------------------------------------------------

@dataclass(frozen=True)
class Layer:
    """A revision that serves rows from ``at`` on, ``hits`` of them (all if none is given)."""

    at: int
    version: str
    kind: str = "drift"
    hits: int | None = None


def accept(layers: Iterable[Layer], most: int | None = None, most_per_kind: int | None = None) -> list[Layer]:
    """The layers that limits on their number, in all and per kind, let in; in row order, earlier ones first."""
    got: list[Layer] = []
    for layer in sorted(layers, key=lambda x: x.at):
        like = sum(x.kind == layer.kind for x in got)
        if (most is None or len(got) < most) and (most_per_kind is None or like < most_per_kind):
            got.append(layer)
    return got


def intervals(layers: Iterable[Layer], n: int, base: str = "base") -> list[tuple[int, int, str]]:
    """Row intervals ``[lo, hi)`` with the version that serves them: the newest layer with hits left.

    A layer begins at its row and ends when its hits are used; what lies below goes on where it stopped.
    Works by change, not by row.
    """
    waiting = sorted((x for x in layers if x.at < n), key=lambda x: -x.at)
    live: list[list] = []  # [version, hits left]
    out: list[tuple[int, int, str]] = []
    row = 0
    while row < n:
        while waiting and waiting[-1].at <= row:
            new = waiting.pop()
            live.append([new.version, n if new.hits is None else new.hits])
        live = [x for x in live if x[1] > 0]
        stop = min(n, waiting[-1].at if waiting else n, row + live[-1][1] if live else n)
        version = live[-1][0] if live else base
        if live:
            live[-1][1] -= stop - row
        if out and out[-1][2] == version:
            out[-1] = (out[-1][0], stop, version)
        else:
            out.append((row, stop, version))
        row = stop
    return out
