"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return str(v)


def compare(spark, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    got = query(spark, sf_dir)
    rows = [r.asDict() for r in got.collect()]
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(got.columns):
        return False, f"columns {sorted(got.columns)} and {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    a = sorted(tuple(_norm(r[n]) for n in order) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in at) for r in want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{len(a)} and {len(b)} rows; {order}; {diff}"
    return True, f"{len(a)} rows"
