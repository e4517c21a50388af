"""Every registered query equals its SQL on DuckDB, row by row."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = {n: q for n, q in entry.queries().items() if n not in entry.LLM}, entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert check(spark, duck, SF, name, QUERIES[name], SQL.get(name)) is None


def test_every_inventory_id_is_registered():
    sizes = {"s": 9, "g": 15, "n": 9, "l": 7, "f": 16, "v": 11, "d": 10, "b": 9, "m": 11, "i": 4, "st": 9}
    have = {n.split("_")[0] for n in QUERIES}
    assert {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)} <= have


def test_entry(spark):
    rows = {r["check"]: r["rows"] for r in entry.entry(spark).collect()}
    assert rows["fault:null_field"] > 0 and rows["fault:duplicate_rows"] > 0
    assert rows["nulls:o_orderkey"] == 0 and rows["nulls:tier"] > 0
