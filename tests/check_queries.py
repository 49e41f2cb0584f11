"""Run the registered queries next to their SQL twins and compare rows.

Usage: python tests/check_queries.py [scale folder] [name part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hearthbook.catalogue import load  # noqa: E402
from hearthbook.catalogue.base import TABLES  # noqa: E402
from hearthbook.session import local_session  # noqa: E402


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: [(x is None, str(type(x)), x) for x in r])


def compare(spark, con, sf_dir, q):
    df = q.run(spark, sf_dir)
    names = df.columns
    got = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return f"rows only ({len(got)})", True
    res = con.execute(q.sql)
    want_names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}", False
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    there = {d[0]: str(d[1]) for d in res.description}
    odd = [(n, t, there[n]) for n, t in df.dtypes if kinds.get(t) != there[n]]
    if odd:
        return f"types differ: {odd}", False
    a, b = rows_of(names, got), rows_of(want_names, want)
    if a == b:
        return f"ok ({len(a)} rows)", True
    sa, sb = set(a), set(b)
    return f"rows {len(a)} vs {len(b)}; only spark {list(sa - sb)[:3]}; only sql {list(sb - sa)[:3]} cols {sorted(names)}", False


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in load().items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            text, ok = compare(spark, con, sf_dir, q)
        except Exception as e:  # noqa: BLE001
            text, ok = f"{type(e).__name__}: {str(e)[:600]}", False
        bad += not ok
        print(f"{'    ' if ok else 'FAIL'} {name:28} {time.time() - t:6.2f}s {text}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
