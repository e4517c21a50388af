"""Random strings that match a regex: literals, classes and their complements, dots, groups, alternation, repeats.

A repeat without an upper end gets ``OPEN_REPEAT`` more than its least number; complements and dots draw from printable
ASCII. Alternatives and numbers of repeats are equally likely each.
"""

from __future__ import annotations

import itertools
import re
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from synthloom.functions.draw import Draw, below
from synthloom.functions.text import char_at
from synthloom.plans.spec import SpecError

# What the class escapes stand for.
CATEGORIES = {
    sre.CATEGORY_DIGIT: "0123456789",
    sre.CATEGORY_WORD: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_",
    sre.CATEGORY_SPACE: " ",
}
PRINTABLE = "".join(map(chr, range(32, 127)))
NEGATED = {sre.CATEGORY_NOT_DIGIT: sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_WORD: sre.CATEGORY_WORD, sre.CATEGORY_NOT_SPACE: sre.CATEGORY_SPACE}
OPEN_REPEAT = 8
UNROLLED = 16   # repeats that are written out; more are drawn in a loop whose number is part of the draws' key


def _alphabet(items, pattern: str) -> str:
    chars: list[str] = []
    for op, arg in items:
        if op is sre.LITERAL:
            chars.append(chr(arg))
        elif op is sre.RANGE:
            chars.extend(chr(c) for c in range(arg[0], arg[1] + 1))
        elif op is sre.CATEGORY and arg in CATEGORIES:
            chars.extend(CATEGORIES[arg])
        elif op is sre.CATEGORY and arg in NEGATED:
            chars.extend(_without(CATEGORIES[NEGATED[arg]]))
        elif op is not sre.NEGATE:
            raise SpecError(f"regex {pattern!r}: unsupported class")
    found = "".join(dict.fromkeys(chars))
    found = _without(found) if items[0][0] is sre.NEGATE else found
    if not found:
        raise SpecError(f"regex {pattern!r}: a class without characters")
    return found


def _without(chars: str) -> str:
    return "".join(c for c in PRINTABLE if c not in chars)


def compile_regex(pattern: str, draw: Draw, path: str, key: tuple[Column, ...]) -> Column:
    """Column of random strings that match ``pattern``; unsupported syntax is refused at load."""
    counter = itertools.count()

    def next_u(at: tuple[Column, ...]) -> Column:
        return draw.u(f"{path}#r{next(counter)}", *key, *at)

    def pick(alphabet: str, at: tuple[Column, ...]) -> Column:
        return char_at(alphabet, below(next_u(at), len(alphabet)))

    def one(op, arg, at: tuple[Column, ...]) -> Column:
        if op is sre.LITERAL:
            return F.lit(chr(arg))
        if op is sre.IN:
            return pick(_alphabet(arg, pattern), at)
        if op is sre.ANY:
            return pick(PRINTABLE, at)
        if op is sre.NOT_LITERAL:
            return pick(_without(chr(arg)), at)
        if op is sre.SUBPATTERN:
            return seq(arg[3], at)
        if op is sre.BRANCH:
            branches = arg[1]
            which = below(next_u(at), len(branches))
            out = F.when(which == 0, seq(branches[0], at))
            for i, b in enumerate(branches[1:], 1):
                out = out.when(which == i, seq(b, at))
            return out
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            lo, hi, body = arg
            hi = lo + OPEN_REPEAT if hi is sre.MAXREPEAT else hi
            if hi <= UNROLLED:
                parts = [seq(body, at) for _ in range(lo)]
                if hi > lo:
                    extra = below(next_u(at), hi - lo + 1)
                    parts += [F.when(extra > i, seq(body, at)).otherwise("") for i in range(hi - lo)]
                return F.concat(F.lit(""), *parts)
            times = F.lit(lo) + (below(next_u(at), hi - lo + 1) if hi > lo else F.lit(0))
            every = F.transform(F.sequence(F.lit(1), times.cast("int")), lambda j: seq(body, (*at, j)))
            return F.when(times > 0, F.array_join(every, "")).otherwise("")
        raise SpecError(f"regex {pattern!r}: unsupported syntax {op}")

    def seq(items, at: tuple[Column, ...] = ()) -> Column:
        parts = [one(op, arg, at) for op, arg in items if op is not sre.AT]
        return F.concat(F.lit(""), *parts)

    try:
        tree = parser.parse(pattern)
    except re.error as e:
        raise SpecError(f"regex {pattern!r}: {e}") from e
    return seq(tree)
