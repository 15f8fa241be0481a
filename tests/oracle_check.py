"""Comparing a query with its SQL, as rows in any order."""

from __future__ import annotations

import math
import os


def connect(data_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(data_dir)):
        path = f"{data_dir}/{f}"
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{where}'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def same(spark_df, con, sql) -> None:
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(spark_df.columns)
    want = rows(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
