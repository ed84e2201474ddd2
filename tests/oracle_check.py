"""Local stand-in for the driver's correctness gate.

Runs every registered query in Spark and its oracle SQL in DuckDB on the same
parquet tables, then compares row count, column names and an order-insensitive
value digest.  Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v) if os.environ.get("STRICT_FLOATS") == "1" else repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def digest(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str, ensure_ascii=False)
                   for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from tidemark.session import local_session
    if os.environ.get("PLAIN_SESSION") == "1":   # a session without any of our settings
        from pyspark.sql import SparkSession
        b = SparkSession.builder.master("local[8]")
        if os.environ.get("SESSION_TZ"):
            b = b.config("spark.sql.session.timeZone", os.environ["SESSION_TZ"])
        spark = b.getOrCreate()
    else:
        spark = local_session(8, 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            report[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, report[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            report[name] = f"rows-only {len(srows)} ({ts:.1f}s)"
            print(name, report[name], flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            report[name] = f"SQL ERROR {str(e)[:300]}"
            print(name, report[name], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_n = len(srows) == len(drows)
        ok_h = ok_cols and digest(scols, srows) == digest(dcols, drows)
        status = "OK" if (ok_cols and ok_n and ok_h) else "MISMATCH"
        report[name] = f"{status} rows {len(srows)}/{len(drows)} cols={ok_cols} hash={ok_h} ({ts:.1f}s)"
        print(name, report[name], flush=True)
        if status != "OK" and not ok_cols:
            print("   spark cols", scols, "\n   duck cols ", dcols)
        if status != "OK" and ok_cols and ok_n:
            order_s = sorted(range(len(scols)), key=lambda i: scols[i])
            order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
            a = sorted(json.dumps([_norm(r[i]) for i in order_s], default=str) for r in srows)
            b = sorted(json.dumps([_norm(r[i]) for i in order_d], default=str) for r in drows)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in diff:
                print("   spark", x[:300], "\n   duck ", y[:300])
    bad = [k for k, v in report.items() if not v.startswith(("OK", "rows-only"))]
    print(f"\n{len(report) - len(bad)}/{len(report)} fine; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
