"""Run registered queries on Spark and their SQL on DuckDB and compare all rows exactly."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import Row

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


TIMES: dict[str, float] = {}


def plain(v):
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, con, sf_dir, name, query, sql):
    """None when equal, else a short description of the difference."""
    started = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    TIMES[name] = time.time() - started
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}: {got[1][:2]} / {want[1][:2]}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(diff)} of {len(got[1])} rows differ, e.g.\n   {diff[0][0][:700]}\n   {diff[0][1][:700]}" if diff else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    import os
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, q in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            problem = check(spark, con, sf, name, q, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {TIMES.get(name, 0):.1f}s of {time.time()-t:.1f}s"
              f"{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)
