"""Compare registered queries with their SQL twins in DuckDB.

    python tools/check.py [--dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb

from lumentab.plans import REGISTRY
from lumentab.plans.registry import TABLES
from lumentab.session import local_session

SPARK_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
    "float": "FLOAT", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]",
    "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]",
}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, q, folder):
    """Returns (ok, message, rows, seconds)."""
    start = time.time()
    df = q(spark, folder)
    rows = df.collect()
    took = time.time() - start
    if q.oracle is None:
        return True, f"rows only: {len(rows)}", len(rows), took
    order = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    cur = con.execute(q.oracle)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != order:
        return False, f"columns {order} vs {sorted(names)}", len(rows), took
    idx = [names.index(c) for c in order]
    other = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    bad_types = [
        (c, t, types[c]) for c, t in df.dtypes
        if SPARK_TYPES.get(t, t) != types[c].replace("STRING", "VARCHAR").replace("NUMBER", "DOUBLE")
    ]
    if mine != other:
        a = [r for r in mine if r not in set(other)][:3]
        b = [r for r in other if r not in set(mine)][:3]
        return False, f"{len(mine)} vs {len(other)} rows\n   cols {order}\n   spark {a}\n   duck  {b}", len(rows), took
    if bad_types:
        return False, f"types {bad_types}", len(rows), took
    return True, "", len(rows), took


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--ids", default="")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session(8)
    con = connect(args.dir)
    failed = 0
    names = args.names or list(REGISTRY)
    for name in names:
        q = REGISTRY[name]
        try:
            ok, msg, n, took = compare(spark, con, q, args.dir)
        except Exception as e:  # report and go on with the next query
            ok, n, took = False, 0, 0
            msg = "".join(traceback.format_exception_only(type(e), e))[:700]
        flag = "ok  " if ok and n else ("EMPTY" if ok else "FAIL")
        failed += flag != "ok  "
        print(f"{flag} {name:28s} {n:8d} rows {took:6.2f}s {msg}", flush=True)
    print(f"{len(names)} queries, {failed} not ok")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
