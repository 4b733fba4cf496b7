"""Run a registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Set PW_EXACT_FLOATS=1 to compare floating-point values bit for bit (by
default they are rounded to 10 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXACT = os.environ.get("PW_EXACT_FLOATS") == "1"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.10g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return v


def rows_key(r):
    return tuple((x is None, str(type(x)), str(x)) for x in r)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    out = {"name": name, "spark_rows": len(srows), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        out["status"] = f"COLUMNS differ: spark={scols} duck={dcols}"
        return out
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    s = sorted((tuple(norm(r[i]) for i in order) for r in srows), key=rows_key)
    d = sorted((tuple(norm(r[i]) for i in dorder) for r in drows), key=rows_key)
    if s == d:
        out["status"] = "MATCH"
    else:
        diff = [(a, b) for a, b in zip(s, d) if a != b][:3]
        out["status"] = "MISMATCH"
        out["cols"] = [scols[i] for i in order]
        out["diff"] = diff
        if len(s) != len(d):
            ss, dd = set(s), set(d)
            out["only_spark"] = list(ss - dd)[:3]
            out["only_duck"] = list(dd - ss)[:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from pipewright.session import local_session
    spark = local_session(8)
    import __spark_entry__ as E
    names = argv[2:] or list(E.queries())
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            r = {"name": n, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("MATCH", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
