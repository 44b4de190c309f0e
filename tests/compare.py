"""Runs queries in Spark and their SQL in DuckDB over the same tables and compares the rows.

python tests/compare.py [SF_DIR] [NAME ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows])


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET temp_directory = ''")  # no spill: a query that doesn't fit fails
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - t0
    if sql is None:
        return f"rows only {len(got)}", spent
    t0 = time.time()
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} {sorted(names)}", spent
    if got != want:
        extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"DIFFERENT {len(got)} {len(want)} spark only {extra} sql only {missing}", spent
    return f"ok {len(got)} (sql {time.time() - t0:.1f} s)", spent


if __name__ == "__main__":
    import __spark_entry__ as entry
    from textloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = duck(sf), entry.queries(), entry.oracle_sql(), 0
    for n, q in queries.items():
        if chosen and n not in chosen and not any(c.endswith("*") and n.startswith(c[:-1]) for c in chosen):
            continue
        try:
            said, spent = compare(spark, con, n, q, oracles.get(n), sf)
        except Exception as e:  # noqa: BLE001
            said, spent = "ERROR " + str(e)[:600], 0
        bad += not said.startswith(("ok", "rows"))
        print(f"{n}: {said} [{spent:.1f} s]", flush=True)
    print("bad:", bad)
