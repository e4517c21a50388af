"""Time encodings: strftime patterns, epoch magnitudes, offsets."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FORMAT = "%Y-%m-%dT%H:%M:%S%z"
SECOND = 1_000_000
DAY = 86_400 * SECOND
# English names, as strftime gives them.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DIRECTIVES = frozenset("YmdHMSfjybBaApIz%")


def calendar_day(us: Column) -> Column:
    """The date of epoch microseconds on the UTC calendar, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY)).cast("int"))


def time_parts(us: Column, fmt: str, offset: str = "+0000") -> list[Column]:
    """The pieces of a strftime format. Everything is integer arithmetic on UTC micros and calendar dates, so no
    session time zone takes part; an unknown directive is an error at spec load."""
    day, inside = calendar_day(us), F.pmod(us, F.lit(DAY))
    hour = F.floor(inside / F.lit(3600 * SECOND))

    def digits(x: Column, n: int) -> Column:
        return F.lpad(x.cast("bigint").cast("string"), n, "0")

    def name(words: tuple[str, ...], at: Column, size: int | None = None) -> Column:
        return F.element_at(F.array(*[F.lit(w[:size]) for w in words]), at.cast("int"))

    parts = {
        "Y": lambda: digits(F.year(day), 4), "y": lambda: digits(F.pmod(F.year(day), F.lit(100)), 2),
        "m": lambda: digits(F.month(day), 2), "d": lambda: digits(F.dayofmonth(day), 2), "j": lambda: digits(F.dayofyear(day), 3),
        "H": lambda: digits(hour, 2), "M": lambda: digits(F.floor(inside / F.lit(60 * SECOND)) % 60, 2),
        "S": lambda: digits(F.floor(inside / F.lit(SECOND)) % 60, 2), "f": lambda: digits(inside % SECOND, 6),
        "I": lambda: digits((hour + 11) % 12 + 1, 2), "p": lambda: F.when(hour < 12, "AM").otherwise("PM"),
        "B": lambda: name(MONTHS, F.month(day)), "b": lambda: name(MONTHS, F.month(day), 3),
        "A": lambda: name(WEEKDAYS, F.weekday(day) + 1), "a": lambda: name(WEEKDAYS, F.weekday(day) + 1, 3),
        "z": lambda: F.lit(offset), "%": lambda: F.lit("%")}
    out = []
    for directive, plain in re.findall(r"%(.)|([^%]+|%$)", fmt, re.DOTALL):
        if plain:
            out.append(F.lit(plain))
        elif directive in DIRECTIVES:
            out.append(parts[directive]())
        else:
            raise ValueError(f"unsupported time directive %{directive} in {fmt!r}")
    return out


def offset_seconds(tz: str | None) -> int:
    """``+HH:MM`` / ``-HH:MM`` / ``Z`` / ``UTC`` to seconds."""
    if tz in (None, "", "Z", "UTC"):
        return 0
    m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})", tz)
    if not m:
        raise ValueError(f"bad tz offset {tz!r}")
    sign = -1 if m[1] == "-" else 1
    return sign * (int(m[2]) * 3600 + int(m[3]) * 60)


def format_micros(us: Column, fmt: str | None = None, tz: str | None = None) -> Column:
    """Epoch microseconds to a strftime-formatted string at a fixed offset."""
    secs = offset_seconds(tz)
    sign, rest = ("-" if secs < 0 else "+"), abs(secs)
    text = f"{sign}{rest // 3600:02d}{rest % 3600 // 60:02d}"
    shifted = us + F.lit(secs * SECOND) if secs else us
    return F.when(us.isNotNull(), F.concat(F.lit(""), *time_parts(shifted, fmt or DEFAULT_FORMAT, text)))


def to_micros(value: object) -> int:
    """A spec literal (ISO text, datetime, epoch s/ms/us by magnitude) to epoch microseconds."""
    if isinstance(value, dt.datetime):
        moment = value
    elif isinstance(value, bool) or value is None:
        raise ValueError(f"not a time: {value!r}")
    elif isinstance(value, (int, float)):
        v = float(value)
        if abs(v) >= 1e15:
            return int(value)
        return int(round(v * (1_000 if abs(v) >= 1e12 else SECOND)))
    else:
        moment = dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def epoch_to_micros(col: Column) -> Column:
    """Numeric epoch column (seconds, milliseconds or microseconds by magnitude) to microseconds."""
    size = F.abs(col)
    return (
        F.when(size >= F.lit(10**15), col.cast("bigint"))
        .when(size >= F.lit(10**12), (col * F.lit(1_000)).cast("bigint"))
        .otherwise((col * F.lit(SECOND)).cast("bigint"))
    )


def text_to_micros(col: Column) -> Column:
    """ISO text (naive = UTC) or ``yyyyMMdd`` to microseconds; null when neither parses.

    A text without a zone gets one before it is parsed, so the session's time zone never decides.
    """
    text = F.trim(col)
    compact = F.try_to_date(F.when(text.rlike(r"^\d{8}$"), text), "yyyyMMdd")
    plain = F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text))
    day = F.unix_date(F.coalesce(compact, plain)).cast("bigint") * F.lit(DAY)
    zoned = text.rlike(r"(?i)(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2}){0,2}|[a-z]+/[a-z_]+)$")
    moment = F.unix_micros(F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))))
    return F.when(text.rlike(r"^(\d{8}|\d{4}-\d{1,2}-\d{1,2})$"), day).otherwise(moment)


def clock_to_micros(col: Column) -> Column:
    """A time-zone free timestamp, read as UTC."""
    seconds = (F.hour(col) * 3600 + F.minute(col) * 60).cast("bigint") * SECOND
    return (F.unix_date(col.cast("date")).cast("bigint") * F.lit(DAY) + seconds
            + (F.date_part(F.lit("SECOND"), col) * SECOND).cast("bigint"))


def micros_to_clock(us: Column) -> Column:
    """A time-zone free timestamp that shows UTC."""
    day, inside = calendar_day(us), F.pmod(us, F.lit(DAY))
    return F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), F.floor(inside / F.lit(3600 * SECOND)).cast("int"),
        (F.floor(inside / F.lit(60 * SECOND)) % 60).cast("int"),
        ((inside % F.lit(60 * SECOND)).cast("decimal(20,6)") / F.lit(SECOND)).cast("decimal(16,6)"))
