"""Compare registered queries with their SQL: ``python check.py [prefix ...] [--sf 0.01]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from pactframe.plans import load
from pactframe.plans.registry import ORACLES, PLANS, Source
from pactframe.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def compare(spark, con, name: str, folder: str):
    """None when equal, else what differs; with the seconds taken and rows."""
    start = time.time()
    df = PLANS[name](Source(spark, folder))
    got = df.collect()
    took = time.time() - start
    mine, cols = rows_of(df.columns, got)
    if name not in ORACLES:
        return None, took, len(mine), 0.0
    start = time.time()
    cur = con.execute(ORACLES[name])
    want_cols = [d[0] for d in cur.description]
    theirs, wcols = rows_of(want_cols, cur.fetchall())
    sql_took = time.time() - start
    if cols != wcols:
        return f"columns {cols} != {wcols}", took, len(mine), sql_took
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:3]
        return f"rows {len(mine)} != {len(theirs)}; mine only {extra}; theirs only {[r for r in theirs if r not in set(mine)][:3]}", took, len(mine), sql_took
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} differing rows, cols {cols}, first {bad[0]}", took, len(mine), sql_took
    return None, took, len(mine), sql_took


def main() -> int:
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    load()
    spark = local_session()
    folder = f"/root/testdata/sf{sf}"
    con = duck(folder)
    failed = 0
    for name in PLANS:
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            diff, took, n, sqls = compare(spark, con, name, folder)
        except Exception as exc:  # noqa: BLE001 - a report, not a handler
            diff, took, n, sqls = f"{type(exc).__name__}: {str(exc)[:900]}", 0, 0, 0
            if len(args) == 1 and not args[0].endswith("*"):
                traceback.print_exc()
        flag = "ok " if diff is None else "BAD"
        failed += diff is not None
        print(f"{flag} {name:32s} rows={n:<7d} spark={took:5.2f}s sql={sqls:5.2f}s {'untested: no SQL' if name not in ORACLES else ''} {'' if diff is None else diff[:1500]}", flush=True)
    print("failed", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
