"""Helpers shared by the registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Suite:
    """Collects (query, SQL) pairs of one operator family."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return register


# --- SQL text for the portable draw -------------------------------------------------------------

def bits(path: str, key: str, seed: str | int = SEED) -> str:
    return f"(('0x'||substr(md5('{seed}|{path}|'||({key})),1,13))::BIGINT)"


def u(path: str, key: str, seed: str | int = SEED) -> str:
    return f"({bits(path, key, seed)}/4503599627370496.0::DOUBLE)"


def below(path: str, key: str, n: str | int, seed: str | int = SEED) -> str:
    return f"(floor({u(path, key, seed)}*{n}::DOUBLE)::BIGINT)"


def digest(path: str, key: str, seed: str | int = SEED) -> str:
    return f"md5('{seed}|{path}|'||({key}))"


def strings(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def text(chars: str) -> str:
    """A literal that survives any encoding: code points joined by chr()."""
    return "(" + "||".join(f"chr({ord(c)})" for c in chars) + ")"


def micros(ts: str) -> str:
    return f"epoch_us({ts})"
