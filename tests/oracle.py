"""Run registered queries against DuckDB: ``python tests/oracle.py SF_DIR [name or prefix ...]``."""
from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return float(v) + 0.0
    if hasattr(v, "as_integer_ratio"):
        return float(v)
    if hasattr(v, "isoformat"):
        s = v.isoformat().replace("T", " ")
        return s[:-9] if s.endswith(" 00:00:00") else s
    return v


def _key(row):
    return tuple((v is None, "" if v is None else f"{v:.3f}" if isinstance(v, (int, float)) else str(v)) for v in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


def same(a, b):
    """(exactly equal, equal within 1e-6 relative)"""
    if a == b:
        return True, True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return False, abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        parts = [same(x, y) for x, y in zip(a, b)]
        return all(p[0] for p in parts), all(p[1] for p in parts)
    return False, False


def compare(spark, con, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", True, took
    t = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    ref = time.time() - t
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", False, took
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", False, took
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y)[0] for x, y in zip(g, w))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g.\n   {got_cols}\n   {bad[0][0]}\n   {bad[0][1]}", False, took
    return f"ok {len(got)} rows (duckdb {ref:.1f}s)", True, took


def session():
    from tidegauge.session import build_session
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as entry
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        try:
            text, ok, took = compare(spark, con, fn, sqls.get(name), sf)
        except Exception as e:                                      # report and go on
            text, ok, took = f"{type(e).__name__}: {str(e)[:1500]}", False, 0.0
        failed += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name} {took:.1f}s {text}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
