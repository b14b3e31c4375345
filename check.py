"""Compare registered queries with their SQL checks: ``python check.py [sf] [name …]``.

Columns are sorted by name and rows by value, as multisets.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

ROOT = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(ours[1])
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}", len(ours[1])
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return f"rows {len(ours[1])} vs {len(theirs[1])}\n  ours only   {sorted(a - b)[:3]}\n  theirs only {sorted(b - a)[:3]}", len(ours[1])
    return None, len(ours[1])


def main(argv):
    from mailweave.session import local_session
    from mailweave.registry import QUERIES, oracle_sql

    ORACLE = oracle_sql()

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == w or n.startswith(w) for w in wanted)]
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{ROOT}/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            diff, n = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception:
            diff, n = "error " + traceback.format_exc(limit=4)[-1500:], -1
        state = "FAIL" if diff else ("ok" if name in ORACLE else "rows")
        bad += bool(diff)
        print(f"{state:5}{name:42}{n:>8} rows {time.time() - start:6.2f} s", flush=True)
        if diff:
            print("   " + diff, flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
