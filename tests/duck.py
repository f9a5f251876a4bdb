"""Compares a query with its SQL the way the driver does: columns by name, rows in any order."""

import math
import os

import duckdb


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def compare(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    rows, cols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted(tuple(norm(r[cols.index(c)]) for c in names) for r in rows)
    assert got == want
    return len(got)
