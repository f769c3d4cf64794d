"""Runs a query and its SQL over the same tables and compares all rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("QUADMILL_TESTDATA", "/root/testdata/sf0.001")


def duck(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x) for x in r])


def same(df, sql, folder=DATA):
    got = duck(folder).execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = in_order(tuple(plain(v) for v in r) for r in got.fetchall())
    have = in_order(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert have == want
