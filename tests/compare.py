"""Runs a registered query and its oracle SQL on the same tables and compares all rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb
import pandas as pd


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, Decimal):
        return float(value)
    if hasattr(value, "item"):
        value = value.item()
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return int(value)
    return value


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t),
    )


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got = _canonical([c.lower() for c in df.columns], [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [c[0].lower() for c in cur.description]
    want = _canonical(want_cols, cur.fetchall())
    if sorted(c.lower() for c in df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; spark {got[:2]} oracle {want[:2]}"
    if not got:
        return "no rows on either side"
    for g, w in zip(got, want):
        if g != w:
            return f"spark {g} oracle {w} (columns {sorted(want_cols)})"
    return None


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from meterlight import build_session
    from meterlight.plans import catalog

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    names = [n for n in catalog.QUERIES if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in names:
        t = time.time()
        try:
            if name in catalog.ORACLES:
                diff = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)
            else:
                n = len(catalog.QUERIES[name](spark, sf_dir).collect())
                diff = None if n else "no rows"
        except Exception as exc:  # report and go on with the next query
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t:.2f}s {diff or ''}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
