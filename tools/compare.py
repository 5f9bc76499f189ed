"""Run registered queries against their checking SQL.

    python tools/compare.py [--sf 0.01] [--time] [name-part ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return "decimal:" + str(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(i) for i in v) + "]"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def check(plan, spark, sf_dir, con):
    started = time.time()
    df = plan.query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if plan.sql is None:
        return took, len(got[1]), None
    started = time.time()
    cur = con.execute(plan.sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(names, cur.fetchall())
    took_sql = time.time() - started
    problem = None
    wide = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    if wide:
        problem = f"wide types in SQL: {wide}"
    if got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        problem = f"rows {len(got[1])} != {len(want[1])}"
        a, b = set(got[1]), set(want[1])
        problem += f"\n   spark only {list(a - b)[:3]}\n   sql only   {list(b - a)[:3]}"
    elif got[1] != want[1]:
        bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
        a, b = set(got[1]), set(want[1])
        problem = f"{len(bad)} rows differ; columns {got[0]}\n   spark only {sorted(a - b)[:3]}\n   sql only   {sorted(b - a)[:3]}"
    return took, len(got[1]), problem, took_sql


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tilespark.plans import load
    from tilespark.session import tune

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = tune(session())
    con = connect(sf_dir)
    bad = 0
    plans = load()
    for name, plan in plans.items():
        if args.names and not any(n == name or n in name for n in args.names):
            continue
        try:
            took, rows, problem, *rest = check(plan, spark, sf_dir, con)
            state = "rows-only" if plan.sql is None else ("ok" if problem is None else "DIFF " + problem)
            if rows == 0:
                state += " EMPTY"
            if problem or rows == 0:
                bad += 1
            print(f"{name:34s} {took:6.2f}s sql {rest[0] if rest else 0:5.2f}s {rows:8d} {state}", flush=True)
        except Exception as e:
            bad += 1
            text = str(e).split("JVM stacktrace")[0][:1500]
            print(f"{name:34s} ERROR {type(e).__name__}: {text}", flush=True)
            if "--trace" in sys.argv:
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main()
