"""Compare registered queries with their DuckDB oracles: ``python scripts/check.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from aligner.plans import registry  # noqa: E402
from aligner.plans.workload import TABLES  # noqa: E402
from aligner.session import local_session  # noqa: E402


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    if sql is None:
        return "rows", f"{len(got)} rows {spark_s:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_s = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} vs {sorted(cols)}"
    g, x = rows(df.columns, got), rows(cols, want)
    info = f"{len(g)} vs {len(x)} rows, spark {spark_s:.1f}s duck {duck_s:.1f}s"
    if g == x:
        return ("ok" if g else "EMPTY"), info
    only_g = [r for r in g if r not in set(x)][:3] if len(g) < 200000 else []
    only_x = [r for r in x if r not in set(g)][:3] if len(g) < 200000 else []
    return "FAIL", f"{info}\n   spark only {only_g}\n   duck only  {only_x}"


def main(sf="sf0.01", *names):
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = registry.all_queries(), registry.all_oracles()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            state, info = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:
            state, info = "ERROR", "".join(traceback.format_exception_only(e))[:1500]
        bad += state not in ("ok", "rows")
        print(f"{state:6} {name}: {info}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
