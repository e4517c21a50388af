"""Specs to columns. No execution happens here: the result is a plan Catalyst can prune and fuse."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.functions import lists as L
from synthloom.functions.draw import Draw, below, pick_weighted
from synthloom.functions.text import char_at
from synthloom.functions.times import (
    SECOND, epoch_to_micros, format_micros, text_to_micros, to_micros)
from synthloom.plans import spec as S
from synthloom.plans.regexes import compile_regex

LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
BLOCK = 8  # characters produced per draw in plain strings
DAY = 86_400 * SECOND


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round_to(x: Column, digits: int) -> Column:
    """Round half to even on the scaled value."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


@dataclass(frozen=True)
class Scope:
    """Where a node is compiled: its path, the key its draws use, siblings, shared draws."""

    draw: Draw
    path: str
    key: tuple[Column, ...]
    row: Column
    now_us: int
    siblings: dict[str, Column]
    stage: dict[str, Column] | None

    def at(self, path: str, **kw) -> "Scope":
        return replace(self, path=path, **kw)

    def u(self, suffix: str = "") -> Column:
        return self.draw.u(self.path + suffix, *self.key)

    def with_u(self, suffix: str, body: Callable[[Column], Column]) -> Column:
        """Use a draw several times: staged as a column at row level, let-bound inside lambdas."""
        if self.stage is None:
            return let(self.u(suffix), body)
        name = f"_u_{self.path}{suffix}"
        self.stage.setdefault(name, self.u(suffix))
        return body(F.col(f"`{name}`"))


def as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """Lift a branch of a union to the union's type."""
    if have == want:
        return col
    if isinstance(want, T.VariantType):
        nested = isinstance(have, (T.StructType, T.ArrayType, T.MapType))
        return F.to_variant_object(col) if nested else col.cast("variant")
    names = {f.name: f.dataType for f in have.fields}
    merged = F.struct(*[
        (as_type(col[f.name], names[f.name], f.dataType) if f.name in names
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
    return F.when(col.isNotNull(), merged)


def value(node: dict[str, Any], sc: Scope) -> Column:
    """Column for one node."""
    custom = S.custom_generator(node["type"])
    if custom:
        return custom[0](node, sc.draw, sc.path, sc.key)
    return _BUILDERS[node["type"]](node, sc)


def _int(node, sc):
    count = (int(node["max"]) - int(node["min"])) // int(node["step"]) + 1
    return F.lit(int(node["min"])) + below(sc.u(), count) * F.lit(int(node["step"]))


def _float(node, sc):
    lo, hi = float(node["min"]), float(node["max"])
    x = sc.u() * F.lit(hi - lo) + F.lit(lo)
    return x if node.get("precision") is None else round_to(x, int(node["precision"]))


def _bool(node, sc):
    return sc.u() < F.lit(float(node["p_true"]))


def _enum(node, sc):
    want = S.data_type(node)
    lits = F.array(*[as_type(F.lit(v), S.literal_type(v), want) for v in node["values"]])
    if node.get("weights"):
        return sc.with_u("", lambda u: F.element_at(lits, pick_weighted(u, node["weights"]) + 1))
    return F.element_at(lits, (below(sc.u(), len(node["values"])) + 1).cast("int"))


def _string(node, sc):
    if node.get("regex"):
        return compile_regex(node["regex"], sc.draw, sc.path, sc.key)
    if node.get("template") is not None:
        return _template(node, sc)
    if node.get("string_type"):
        return _provider(node["string_type"], sc)
    return _plain(node, sc)


def _template(node, sc):
    charset = node.get("n_charset") or {
        "numeric": DIGITS, "lower": LOWER}.get(node.get("n_type"), LOWER.upper())
    per_draw = 15 if charset == DIGITS else max(1, int(45 / math.log2(max(2, len(charset)))))
    parts, token = [], 0
    for text in re.split(r"(\{n+\})", node["template"]):
        if not re.fullmatch(r"\{n+\}", text):
            parts += [F.lit(text)] if text else []
            continue
        left, chunk = len(text) - 2, 0
        while left > 0:
            size = min(left, per_draw)
            parts.append(_chars(charset, size, sc, f"#{token}.{chunk}"))
            left, chunk = left - size, chunk + 1
        token += 1
    return F.concat(F.lit(""), *parts)


def _chars(charset: str, size: int, sc: Scope, suffix: str) -> Column:
    """``size`` characters out of one draw: the draw written in base ``len(charset)``."""
    base = len(charset)
    if charset == DIGITS:
        return F.lpad(below(sc.u(suffix), 10**size).cast("string"), size, "0")
    if size == 1:
        return char_at(charset, below(sc.u(suffix), base))

    def spell(u: Column) -> Column:
        n = below(u, base**size)
        return F.concat(*[char_at(charset, F.floor(n / F.lit(base**j)) % base)
                          for j in range(size - 1, -1, -1)])

    return sc.with_u(suffix, spell)


def _plain(node, sc):
    lo = int(node.get("min_length") or 1)
    hi = max(lo, int(100 if node.get("max_length") is None else node["max_length"]))
    charset = node.get("charset") or node.get("n_charset") or LOWER
    base = len(charset)

    def block(v: Column) -> Column:
        return F.concat(*[char_at(charset, F.floor(v / F.lit(base**j)) % base)
                          for j in range(BLOCK)])

    def text(u: Column) -> Column:
        size = F.lit(lo) + below(u, hi - lo + 1)
        numbers = F.transform(
            F.sequence(F.lit(0), F.floor((size - 1) / F.lit(BLOCK)).cast("int")),
            lambda j: below(sc.draw.u(sc.path + "#c", *sc.key, j), base**BLOCK))
        return F.substring(F.array_join(F.transform(numbers, block), ""), F.lit(1), size.cast("int"))

    return sc.with_u("#len", text)


def _dictionary(words: list[str], sc: Scope, suffix: str) -> Column:
    arr = F.array(*[F.lit(w) for w in words])
    return F.element_at(arr, (below(sc.u(suffix), len(words)) + 1).cast("int"))


def _uuid4(sc: Scope) -> Column:
    def layout(h: Column) -> Column:
        variant = char_at("89ab", F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4)
        return F.concat_ws(
            "-", F.substring(h, 1, 8), F.substring(h, 9, 4),
            F.concat(F.lit("4"), F.substring(h, 14, 3)),
            F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

    digest = sc.draw.digest(sc.path + "#uuid", *sc.key)
    if sc.stage is None:
        return let(digest, layout)
    name = f"_u_{sc.path}#uuid"
    sc.stage.setdefault(name, digest)
    return layout(F.col(f"`{name}`"))


def _provider(name: str, sc: Scope) -> Column:
    """A realistic value by provider name; a dotted name uses its last part."""
    short = name.rsplit(".", 1)[-1]
    first, last = (lambda: _dictionary(L.FIRST_NAMES, sc, "#first")), (
        lambda: _dictionary(L.LAST_NAMES, sc, "#last"))
    word = lambda: _dictionary(L.WORDS, sc, "#word")
    host = lambda: _dictionary(L.MAIL_HOSTS, sc, "#host")
    digits = lambda k, tag: _chars(DIGITS, k, sc, tag)
    made = {
        "word": word,
        "first_name": first,
        "last_name": last,
        "name": lambda: F.concat_ws(" ", first(), last()),
        "city": lambda: _dictionary(L.CITIES, sc, "#city"),
        "state": lambda: _dictionary(L.STATES, sc, "#state"),
        "email": lambda: F.concat(F.lower(first()), F.lit("."), F.lower(last()), digits(3, "#n"),
                                  F.lit("@"), host()),
        "url": lambda: F.concat(F.lit("https://www."), word(), F.lit("."), host(), F.lit("/"),
                                digits(4, "#n")),
        "phone_number": lambda: F.concat(F.lit("+1-"), digits(3, "#a"), F.lit("-555-"),
                                         digits(4, "#n")),
        "uuid4": lambda: _uuid4(sc),
    }.get(short)
    if made is None:
        raise S.SpecError(f"{sc.path}: unknown string_type {name!r}")
    return made()


def _window(node, sc, default_start: int) -> tuple[int, int]:
    start = to_micros(node["start"]) if node.get("start") is not None else default_start
    end = to_micros(node["end"]) if node.get("end") is not None else sc.now_us
    if end < start:
        raise S.SpecError(f"{sc.path}: end is before start")
    return start, end


def _uniform_micros(start: int, end: int, sc: Scope) -> Column:
    return F.lit(start) + F.rint(sc.u() * F.lit(float(end - start))).cast("bigint")


def _year_back(now_us: int) -> int:
    now = dt.datetime.fromtimestamp(now_us / SECOND, dt.timezone.utc)
    day = 28 if (now.month, now.day) == (2, 29) else now.day
    return to_micros(now.replace(year=now.year - 1, day=day))


def _sibling(node, sc) -> Column:
    if node["depends_on"] not in sc.siblings:
        raise S.SpecError(f"{sc.path}: depends_on {node['depends_on']!r} is not available")
    return sc.siblings[node["depends_on"]]


def _timestamp(node, sc):
    if node.get("depends_on"):
        src = _sibling(node, sc)
        bad = F.raise_error(F.concat(F.lit(f"{sc.path}: cannot parse "), src)).cast("bigint")
        parsed = F.coalesce(text_to_micros(src), bad)
        return F.when(src.isNotNull(), parsed)
    return _uniform_micros(*_window(node, sc, _year_back(sc.now_us)), sc)


def _clock(text: str, where: str) -> int:
    m = re.fullmatch(r"(\d{2}):(\d{2})(?::(\d{2}))?", text)
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3] or 0) > 59:
        raise S.SpecError(f"{where}: time must be HH:MM[:SS], got {text!r}")
    return (int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)) * SECOND


def _datetime(node, sc):
    fmt, tz = node.get("format"), node.get("tz")
    if node.get("depends_on"):
        return format_micros(epoch_to_micros(_sibling(node, sc)), fmt, tz)
    clock = node.get("time_start") is not None or node.get("time_end") is not None
    if clock and node.get("start") is None and node.get("end") is None:
        day = sc.now_us - sc.now_us % DAY
        start = day + _clock(node.get("time_start") or "00:00:00", sc.path)
        end = day + _clock(node.get("time_end") or "23:59:59", sc.path)
        if end < start:
            raise S.SpecError(f"{sc.path}: time_end is before time_start")
    else:
        start, end = _window(node, sc, sc.now_us - 365 * DAY)
    return format_micros(_uniform_micros(start, end, sc), fmt, tz)


def _stateful(node, sc):
    """Arithmetic sequence in closed form: the first row already holds start + increment."""
    start = to_micros(node["start"]) if node.get("start") is not None else sc.now_us
    step = int(node.get("increment") or SECOND)
    us = F.lit(start) + (sc.row + 1) * F.lit(step)
    return us if node.get("end") is None else F.least(us, F.lit(to_micros(node["end"])))


def _stateful_text(node, sc):
    return format_micros(_stateful(node, sc), node.get("format"), node.get("tz"))


def _array(node, sc):
    lo, hi, child = node["min_items"], node["max_items"], node["child"]
    size = F.lit(lo) if hi == lo else F.lit(lo) + below(sc.u("#size"), hi - lo + 1)
    empty = F.array().cast(S.data_type(node))
    if hi == 0:
        return empty

    def body(k: Column) -> Column:
        filled = F.transform(
            F.sequence(F.lit(1), k.cast("int")),
            lambda j: value(child, sc.at(sc.path + "[]", key=(*sc.key, j - 1), stage=None)))
        return filled if lo > 0 else F.when(k > 0, filled).otherwise(empty)

    return body(size) if lo > 0 else let(size, body)


def object_fields(node, sc) -> list[tuple[str, Column]]:
    """Columns of an object's fields in dependency order, siblings substituted by expression."""
    made: dict[str, Column] = {}
    for level in S.field_levels(node["fields"]):
        for name in level:
            made[name] = field(name, node["fields"][name], replace(sc, siblings=made))
    return [(name, made[name]) for name in node["fields"]]


def field(name: str, node: dict, sc: Scope) -> Column:
    """One object field: binding key, value, default and required checks."""
    inner = sc.at(f"{sc.path}.{name}".lstrip("."))
    if node.get("bound_to") and "pool" not in node:
        anchor = sc.siblings[node["bound_to"]].cast("string")
        rev = str(node.get("bound_to_revision") or 0)
        bound = F.concat(F.lit(f"bind|{rev}|"), anchor)
        plain = F.concat_ws("|", *[k.cast("string") for k in sc.key])
        inner = inner.at(inner.path, key=(F.coalesce(bound, plain),))
    col = value(node, inner)
    if node.get("default") is not None:
        return F.coalesce(col, F.lit(node["default"]).cast(S.data_type(node)))
    if node.get("required"):
        stop = F.raise_error(F.lit(f"required field {inner.path} is null"))
        return F.coalesce(col, stop.cast(S.data_type(node)))
    return col


def _object(node, sc):
    return F.struct(*[c.alias(n) for n, c in object_fields(node, sc)])


def _maybe(node, sc):
    p = float(node["p_null"])
    return F.when(sc.u("#null") >= F.lit(p), value(node["child"], sc.at(sc.path + ".?")))


def _one_of(node, sc):
    want, choices = S.data_type(node), node["choices"]
    cols = [as_type(value(c, sc.at(f"{sc.path}|{i}")), S.data_type(c), want)
            for i, c in enumerate(choices)]
    weights = node.get("weights")
    if len(cols) == 1:
        return cols[0]

    def choose(u: Column) -> Column:
        if weights is None:
            which = below(u, len(cols))
            out = F.when(which == 0, cols[0])
            for i, c in enumerate(cols[1:-1], 1):
                out = out.when(which == i, c)
            return out.otherwise(cols[-1])
        total, acc, out = float(sum(weights)), float(weights[0]), None
        out = F.when(u * F.lit(total) <= F.lit(acc), cols[0])
        for w, c in zip(weights[1:-1], cols[1:-1]):
            acc += float(w)
            out = out.when(u * F.lit(total) <= F.lit(acc), c)
        return out.otherwise(cols[-1])

    return sc.with_u("#pick", choose)


def _select(node, sc):
    """Required options plus k optional ones, drawn by weight without replacement.

    Each optional key gets an exponential race time -ln(1-u)/w; the k earliest win, which is the
    law of sequential weighted draws. With few options, counting earlier rivals beats sorting.
    """
    options, pick = node["options"], node["pick"]
    optional = [k for k, o in options.items() if not o["required"]]
    weights = {k: float((pick.get("weights") or {}).get(k, 1.0)) for k in optional}
    n, mode = len(optional), pick["mode"]

    def count() -> Column:
        if mode == "exact":
            return F.lit(int(pick["min"]))
        lo, hi = {
            "range": (pick.get("min"), pick.get("max")),
            "at_least_one": (1, n),
            "any": (pick.get("min") or 0, n if pick.get("max") is None else pick["max"]),
        }[mode]
        lo, hi = int(lo), max(int(lo), int(hi))
        return F.lit(lo) + below(sc.u("#count"), hi - lo + 1)

    def race(k: str) -> Column:
        w = weights[k]
        if w == 0:
            return F.lit(float("inf"))
        return -F.log(F.lit(1.0) - sc.draw.u(f"{sc.path}.{k}#race", *sc.key)) / F.lit(w)

    def build(draws: Column) -> Column:
        def chosen(i: int) -> Column:
            mine = draws[i + 1]
            ahead = sum(
                ((draws[j + 1] < mine) | ((draws[j + 1] == mine) & F.lit(j < i))).cast("int")
                for j in range(n) if j != i) if n > 1 else F.lit(0)
            return ahead < draws[0]

        cols = []
        for k, o in options.items():
            child = value(o["of"], sc.at(f"{sc.path}.{k}", stage=None))
            cols.append((child if o["required"] else F.when(chosen(optional.index(k)), child)).alias(k))
        return F.struct(*cols)

    draws = F.array(count().cast("double"), *[race(k) for k in optional])
    if sc.stage is None:
        return let(draws, build)
    name = f"_u_{sc.path}#select"
    sc.stage.setdefault(name, draws)
    return build(F.col(f"`{name}`"))


_BUILDERS = {
    "int": _int, "float": _float, "bool": _bool, "enum": _enum, "string": _string,
    "timestamp": _timestamp, "datetime": _datetime, "stateful_timestamp": _stateful,
    "stateful_datetime": _stateful_text, "array": _array, "object": _object, "maybe": _maybe,
    "object_or_null": _maybe, "string_or_null": _maybe, "one_of": _one_of, "select": _select,
}


def now_micros() -> int:
    return to_micros(dt.datetime.now(dt.timezone.utc))


def add_fields(
    df: DataFrame, spec: dict[str, Any], draw: Draw, key: str, row: str, now: object = None,
    given: tuple[str, ...] = (),
) -> DataFrame:
    """Append the columns of a normalised root spec to ``df``.

    Fields in ``given`` are already columns of ``df`` (pool links). Draws used more than once sit in
    their own projection below the fields, so each hash is computed once per row.
    """
    fields = spec["fields"]
    now_us = now_micros() if now is None else to_micros(now)
    made = {g: F.col(f"`{g}`") for g in given}
    for level in S.field_levels(fields):
        stage: dict[str, Column] = {}
        sc = Scope(draw, "", (F.col(f"`{key}`"),), F.col(f"`{row}`"), now_us, made, stage)
        cols = {n: field(n, fields[n], sc) for n in level if n not in made}
        kept = [F.col(f"`{c}`") for c in df.columns]
        if stage:
            df = df.select(*kept, *[c.alias(n) for n, c in stage.items()])
        df = df.select(*kept, *[c.alias(n) for n, c in cols.items()])
        made = {**made, **{n: F.col(f"`{n}`") for n in cols}}
    return df
