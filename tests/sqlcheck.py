"""Comparing a query's rows with its SQL on the same tables."""

import os

import duckdb

from harvestry.sources.tables import TABLES


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def connect(base):
    c = duckdb.connect()
    for t in TABLES:
        f = f"{base}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return c


def same_rows(df, sql, base):
    cursor = connect(base).execute(sql)
    names = sorted(df.columns)
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[n]) for n in names) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == want
