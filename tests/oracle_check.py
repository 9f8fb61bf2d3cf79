"""Run registered queries in Spark and their SQL in DuckDB; compare results.

    python tests/oracle_check.py [sf_dir] [name ...]

Comparison: row count, column names (sorted), and an order-insensitive digest
of the values (floats rounded to 6 places, timestamps as ISO text).
"""
from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        s_rows = [tuple(r) for r in df.collect()]
        s_cols = list(df.columns)
        t1 = time.time()
        if name not in sql:
            results[name] = ("rows-only", len(s_rows))
            print(f"{name:32s} spark={len(s_rows)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        cur = con.execute(sql[name])
        d_cols = [c[0] for c in cur.description]
        d_rows = cur.fetchall()
        hs, ls = digest(s_cols, s_rows)
        hd, ld = digest(d_cols, d_rows)
        ok = (len(s_rows) == len(d_rows) and sorted(s_cols) == sorted(d_cols) and hs == hd)
        results[name] = ok
        print(f"{name:32s} {'OK ' if ok else 'BAD'} spark={len(s_rows)} duck={len(d_rows)} "
              f"{t1 - t0:.1f}s")
        if not ok and verbose:
            if sorted(s_cols) != sorted(d_cols):
                print("   cols spark:", sorted(s_cols))
                print("   cols duck :", sorted(d_cols))
            only_s = sorted(set(ls) - set(ld))[:5]
            only_d = sorted(set(ld) - set(ls))[:5]
            for x in only_s:
                print("   spark only:", x[:400])
            for x in only_d:
                print("   duck  only:", x[:400])
    return results


if __name__ == "__main__":
    from dockline.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v is False]
    print("FAILED:", bad if bad else "none")
