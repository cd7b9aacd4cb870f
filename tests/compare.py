"""Run registered queries on Spark and their check SQL in an in-process DuckDB, and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


STRICT = bool(os.environ.get("STRICT"))  # last bit of every double, and the Python type of every cell


def cell(x):
    if x is None:
        return "~"
    if STRICT and not isinstance(x, (dt.date, list, tuple, dict)):
        return f"{type(x).__name__}:{x!r}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        if math.isnan(x):
            return "nan"
        return "0" if x == 0 else f"{x:.12g}"
    if isinstance(x, dt.datetime):
        return x.isoformat() if x.time() != dt.time(0) else x.date().isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(cell(v) for v in x) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{cell(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, plan, sql, d):
    """None when equal, else a description of the first difference; with row count and Spark seconds."""
    t0 = time.time()
    df = plan(spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return None, len(got[1]), took
    res = con.execute(sql)
    want = rows_of([c[0] for c in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}", len(got[1]), took
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}", len(got[1]), took
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return (f"{len(bad)} rows differ: {got[0]} spark={bad[0][0]} sql={bad[0][1]}" if bad else None), len(got[1]), took


if __name__ == "__main__":
    from tallyscope.plans import PLANS, SQL
    from tallyscope.session import build_session

    sf = os.environ.get("SF", "0.01")
    names = sys.argv[1:] or list(PLANS)
    names = [n for n in PLANS if n in names or any(x.endswith("*") and n.startswith(x[:-1]) for x in names)]
    d = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(d), 0
    for n in names:
        try:
            diff, count, took = compare(spark, con, PLANS[n], SQL.get(n), d)
        except Exception as e:  # noqa: BLE001
            diff, count, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        failed += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {n:32s} rows={count:<7d} {took:5.1f}s {'' if n in SQL else 'NOSQL'} {diff or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
