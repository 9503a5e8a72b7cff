"""Comparison of a query with its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def assert_same(df, db, sql):
    """Equal columns and rows, in any order."""
    columns = sorted(df.columns)
    mine = [tuple(map(_plain, r)) for r in df.select(columns).collect()]
    other = db.sql(sql)
    assert sorted(other.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = [tuple(map(_plain, r)) for r in db.sql(f"SELECT {names} FROM ({sql})").fetchall()]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(mine, key=order) == sorted(theirs, key=order)
