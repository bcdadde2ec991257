"""Compare registered Spark jobs with their DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: OK / MISMATCH (with details) / ERROR.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return v
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in records:
        out.append(tuple(_norm(r[i]) for i in order))
    return sorted(out, key=lambda x: tuple((v is None, str(v)) for v in x))


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    msg = []
    if sorted(s_cols) != sorted(d_cols):
        msg.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return False, "; ".join(msg), t1 - t0
    if len(s_rows) != len(d_rows):
        msg.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        msg.append(f"values differ, first: {diff}")
    return not msg, "; ".join(msg), t1 - t0


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    keys = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            keys.append(a)
    import __spark_entry__ as E
    from tankwise.session import build_session
    spark = build_session()
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    keys = keys or list(q)
    bad = 0
    for k in keys:
        if k not in o:
            try:
                t0 = time.time()
                n = q[k](spark, sf_dir).count()
                print(f"ROWS-ONLY {k}: {n} rows ({time.time() - t0:.1f}s)", flush=True)
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERROR {k}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        try:
            ok, m, secs = compare(spark, con, k, q[k], o[k], sf_dir)
            print(f"{'OK' if ok else 'MISMATCH'} {k} ({secs:.1f}s) {m}", flush=True)
            bad += 0 if ok else 1
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {k}: {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"done: {len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
