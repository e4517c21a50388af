"""String damage as column expressions: nine corruption strategies, byte cuts, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from synthloom.functions import lists as L
from synthloom.functions.draw import Draw, below

# Strategy names, in draw order.
STRATEGIES = (
    "replacement", "delete", "swap", "zero_width", "homoglyph",
    "fullwidth", "append_ff", "insert_conf", "accent",
)


def char_at(chars: str, index: Column) -> Column:
    """Character ``index`` (0-based) of a literal alphabet."""
    return F.substring(F.lit(chars), (index + 1).cast("int"), F.lit(1))


def splice(s: Column, at: Column, drop: int, put: Column) -> Column:
    """Replace ``drop`` characters at 0-based position ``at`` by ``put``."""
    head = F.substring(s, F.lit(1), at.cast("int"))
    tail = F.substring(s, (at + 1 + drop).cast("int"), F.length(s))
    return F.concat(head, put, tail)


def nth_matching(s: Column, alphabet: str, u: Column) -> Column:
    """0-based position of a random character of ``s`` that is in ``alphabet`` (null if none).

    One split finds all hits; the text before the chosen hit is the leading pieces joined again.
    """
    pieces = F.split(s, f"[{alphabet}]", -1)
    hits = F.size(pieces) - 1
    nth = below(u, hits)
    before = F.array_join(F.slice(pieces, 1, (nth + 1).cast("int")), "x")
    return F.when(hits > 0, F.length(before).cast("bigint"))


def strategy_name(draw: Draw, path: str, key: Column) -> Column:
    """Name of the strategy drawn for a cell."""
    return F.element_at(
        F.array(*[F.lit(n) for n in STRATEGIES]),
        (below(draw.u(path + "#how", key), len(STRATEGIES)) + 1).cast("int"))


def corrupt(s: Column, how: Column, u_pos: Column, u_chr: Column) -> Column:
    """Corrupt one string by a named strategy. Null and empty strings are returned unchanged.

    Fallbacks: a swap of equal neighbours or a too short string becomes an accent, text without a
    look-alike gets U+FFFD, text without ASCII letters or digits gets a zero-width character.
    """
    n = F.length(s)
    pos, gap = below(u_pos, n), below(u_pos, n + 1)
    swap_at = below(u_pos, n - 1)
    left = F.substring(s, (swap_at + 1).cast("int"), F.lit(1))
    right = F.substring(s, (swap_at + 2).cast("int"), F.lit(1))
    replaced = splice(s, pos, 1, F.lit(L.REPLACEMENT))
    zero = splice(s, gap, 0, char_at(L.ZERO_WIDTH, below(u_chr, len(L.ZERO_WIDTH))))
    accent = splice(s, pos, 0, char_at(L.COMBINING, below(u_chr, len(L.COMBINING))))

    def look_alike(src: str, dst: str, fallback: Column) -> Column:
        at = nth_matching(s, src, u_pos)
        ch = F.translate(F.substring(s, (at + 1).cast("int"), F.lit(1)), src, dst)
        return F.coalesce(splice(s, at, 1, ch), fallback)

    return (
        F.when(s.isNull() | (n == 0), s)
        .when(how == "replacement", replaced)
        .when((how == "delete") & (n > 1), splice(s, pos, 1, F.lit("")))
        .when((how == "swap") & (n > 1) & (left != right),
              splice(s, swap_at, 2, F.concat(right, left)))
        .when(how == "zero_width", zero)
        .when(how == "homoglyph", look_alike(L.HOMOGLYPH_FROM, L.HOMOGLYPH_TO, replaced))
        .when(how == "fullwidth", look_alike(L.ASCII_ALNUM, L.FULLWIDTH_ALNUM, zero))
        .when(how == "append_ff", F.concat(s, char_at(L.FULLWIDTH_DIGITS, below(u_chr, 10))))
        .when(how == "insert_conf",
              splice(s, gap, 0, char_at(L.CONFUSABLE, below(u_chr, len(L.CONFUSABLE)))))
        .otherwise(accent))


def cut_bytes(s: Column, u: Column) -> Column:
    """Cut text after byte 1..len-1 and drop the broken tail character."""
    size = F.octet_length(s)
    keep = F.when(size <= 1, F.lit(1)).otherwise(below(u, size - 1) + 1)
    part = F.substring(F.encode(s, "UTF-8"), F.lit(1), keep.cast("int"))
    return F.regexp_replace(F.make_valid_utf8(part.cast("string")), f"{L.REPLACEMENT}+$", "")


def cut_chars(s: Column, u: Column) -> Column:
    """Cut text after character 1..len-1."""
    size = F.length(s)
    keep = F.when(size <= 1, F.lit(1)).otherwise(below(u, size - 1) + 1)
    return F.substring(s, F.lit(1), keep.cast("int"))


def padding(draw: Draw, path: str, key: Column, size: int) -> Column:
    """``size`` pseudo-random printable ASCII characters: md5 blocks spread over 95 characters.

    Each 32-digit block is shifted to its own alphabet, so a block costs one hash.
    """
    blocks = (size + 31) // 32
    src = "0123456789abcdef"
    spread = "".join(chr(32 + (37 * i + 5) % 95) for i in range(16))
    body = F.transform(
        F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))),
        lambda j: F.translate(draw.digest(path, key, j), src, spread))
    return F.substring(F.array_join(body, ""), 1, size) if size else F.lit("")


def repeat_tail(s: Column, need: int) -> Column:
    """Grow text by ``need`` characters (at least 8) of its last word, repeated."""
    need = max(8, need)
    word = F.regexp_extract(s, r"(\S+)\s*$", 1)
    token = F.when(F.length(word) > 0, word).otherwise(s)
    reps = F.ceil(F.lit(need) / (F.length(token) + 1))
    more = F.repeat(F.concat(token, F.lit(" ")), reps.cast("int"))
    return F.concat(s, F.substring(more, 1, need))
