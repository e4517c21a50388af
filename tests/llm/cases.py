"""Awkward rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, rep long"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def prose(rng: random.Random, n: int, names: int = 400) -> str:
    return " ".join(f"{rng.choice('aeiou')}{rng.choice('bcdfgh')}{rng.randrange(names)}" + rng.choice(["", "", ".", ",", "\n"])
                    for _ in range(n))


def texts(seed: int = 1, n: int = 60) -> list[str]:
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out = [prose(rng, rng.randrange(5, 120)) for _ in range(n)]
    for i in range(0, n, 5):
        out[i] = f"{out[i]} {passage} {prose(rng, 20)}"
    out[7] = out[3]
    out[11] = out[3]
    base = prose(rng, 200).split(" ")
    for k in (20, 21, 22, 23):
        near = list(base)
        near[k] = "changed"
        out[k] = " ".join(near)
    return out


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with unique ids in shuffled order, and odd texts."""
    rng = random.Random(seed)
    odd = ["", " \t\n ", "a", "Ä é 中 😀 " * 30, "x" * 5000, "the the the " * 300, prose(rng, 4), prose(rng, 30_000, 5000), None]
    own = [*texts(seed, n), *odd]
    out = [(i * 3, t, "en", "s", None if t is None else len(t), 0.5, "k", i) for i, t in enumerate(own)]
    rng.shuffle(out)
    return out


def documents(spark, extra: bool = True):
    """``rows`` and, with ``extra``, repeated rows and rows without an id."""
    own = rows()
    if extra:
        own = [*own, own[0], own[0], (None, "no id at all", None, None, None, None, None, None), (None, None) + (None,) * 6]
    return spark.createDataFrame(own, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
