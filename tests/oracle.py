"""Rows of a query and of its SQL, made comparable."""

import datetime
import decimal
import math
import os

import duckdb

from corpuslens.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return v


def duck(sf_dir=SF):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted(str(tuple(value(r[c]) for c in columns)) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(str(tuple(value(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert ours == theirs
    return len(ours)
