"""Whole specs of a harbour: manifests, instrument readings, shipments, and one with every kind of node."""

from __future__ import annotations


def text_of(pattern: str) -> dict:
    return {"type": "string", "template": pattern, "n_type": "numeric"}


def drawn(kind: str) -> dict:
    return {"type": "string", "string_type": kind}


def perhaps(child: dict | str, p_null: float) -> dict:
    return {"type": "maybe", "p_null": p_null, "child": child}


def record(**fields) -> dict:
    return {"type": "object", "fields": fields}


def several(child: dict | str, least: int, most: int) -> dict:
    return {"type": "array", "min_items": least, "max_items": most, "child": child}


def between(least: float, most: float, precision: int) -> dict:
    return {"type": "float", "min": least, "max": most, "precision": precision}


SEASON = {"type": "timestamp", "start": "2023-03-01T00:00:00+00:00", "end": "2024-11-15T12:00:00+00:00"}

FLAT = record(
    id=text_of("ORD-{nnnnnn}"), amount=between(5, 500, 2), count={"type": "int", "min": 1, "max": 100},
    tier={"type": "enum", "values": ["free", "pro", "enterprise"], "weights": [60, 30, 10]},
    ok={"type": "bool", "p_true": 0.9}, city=perhaps(drawn("city"), 0.2), at=SEASON,
    day={"type": "datetime", "format": "%Y%m%d", "depends_on": "at"},
    tick={"type": "stateful_timestamp", "start": 1_700_000_000_000_000, "increment": 250_000})

READINGS = record(
    reading=drawn("uuid4"), station=text_of("ST-{nnn}"), taken=SEASON,
    sky={"type": "enum", "values": ["clear", "hazy", "overcast", "fog"], "weights": [8, 5, 4, 1]},
    observer=perhaps(drawn("first_name"), 0.5), calibrated={"type": "bool", "p_true": 0.75},
    samples=several(record(sensor=drawn("word"), found={"type": "one_of", "choices": [
        record(celsius=between(-30, 45, 1)), record(millibar={"type": "int", "min": 940, "max": 1060}),
        record(remark=drawn("word")), record(alarm="bool")]}), 1, 4))

SHIPMENTS = record(
    booked=SEASON, book_day={"type": "datetime", "format": "%d.%m.%Y", "depends_on": "booked"},
    route={"type": "enum", "values": ["north", "coast", "canal"], "weights": [2, 2, 1]},
    sender=drawn("uuid4"), agent=perhaps(drawn("first_name"), 0.7),
    carrier={"type": "one_of", "weights": [5, 3, 2], "choices": [
        record(plate=text_of("T{nnnn}"), axles={"type": "int", "min": 2, "max": 6}),
        record(train=text_of("R{nn}"), wagons={"type": "int", "min": 4, "max": 40}, electric="bool"),
        record(barge=drawn("word"), draught=between(1, 4, 2))]},
    port=record(town=drawn("city"), berth={"type": "int", "min": 1, "max": 24}),
    goods=several(record(article=text_of("A{nnnnn}"), kilos=between(0.5, 900, 2), pieces={"type": "int", "min": 1, "max": 60}), 0, 3))

EVERY_NODE = record(
    berth={"type": "int", "min": 1, "max": 24}, draught=between(0.0, 18.0, 3), loaded="bool",
    label=text_of("HB-{nnnn}"), call_sign={"type": "string", "regex": "^[A-Z]{4}[2-7]$"},
    flag={"type": "enum", "values": ["red", "white", "blue", "green"]}, pilot=perhaps(drawn("word"), 0.35),
    cargo={"type": "one_of", "weights": [5, 2], "choices": [{"type": "int", "min": 100, "max": 180}, text_of("lot {nnn}")]},
    crew=several(drawn("word"), 1, 4),
    engine=record(serial={"type": "int", "min": 200, "max": 899}, running="bool", temperatures=several(between(20, 95, 1), 1, 2)),
    extras={"type": "select", "pick": {"mode": "range", "min": 1, "max": 2}, "options": {
        "deck": {"of": {"type": "int", "min": 4, "max": 4}, "required": True}, "radar": {"of": "bool"}, "mascot": {"of": drawn("word")}}},
    home={"type": "string_or_null", "of": drawn("city"), "weights": [5, 2]},
    arrived=SEASON, noted={"type": "datetime", "format": "%Y-%m-%dT%H:%M:%S"},
    pulse={"type": "stateful_timestamp", "start": 1_700_000_000_000_000, "increment": 250_000},
    log={"type": "stateful_datetime", "start": 1_700_000_000_000_000, "increment": 250_000, "format": "%H:%M:%S", "tz": "+00:00"})
