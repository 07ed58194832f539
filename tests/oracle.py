"""Comparing a query with its SQL, as multisets of rows."""

import glob
import os

import duckdb


def connect(d):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == names
    want = sorted((tuple(r[cols.index(n)] for n in names) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want
