"""Run registered queries against their SQL in DuckDB: ``python tests/check_queries.py [sf] [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else float(f"{number:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None):
    """(ok, message, seconds)."""
    start = time.time()
    got_df = run(spark, sf_dir)
    columns = sorted(got_df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in got_df.collect())
    seconds = time.time() - start
    if sql is None:
        return sum(got.values()) > 0, f"{sum(got.values())} rows, no SQL", seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return False, f"columns {columns} / {sorted(names)}", seconds
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    if got == want:
        return sum(got.values()) > 0, f"{sum(got.values())} rows", seconds
    extra, lacking = list((got - want).items())[:3], list((want - got).items())[:3]
    return False, f"{sum(got.values())} / {sum(want.values())} rows\n   {columns}\n   only here: {extra}\n   only SQL:  {lacking}", seconds


if __name__ == "__main__":
    from tablehaul.plans import QUERIES, SQL
    from tablehaul.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = duck(folder)
    bad = 0
    for name in names:
        try:
            ok, message, seconds = compare(spark, con, folder, name, QUERIES[name], SQL.get(name))
        except Exception as e:  # noqa: BLE001
            ok, message, seconds = False, f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += not ok
        print("ok  " if ok else "FAIL", f"{name:28s} {seconds:6.2f}s  {message}", flush=True)
    print("failed:", bad)
