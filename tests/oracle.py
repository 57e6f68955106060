"""Compares a registered query with its SQL in DuckDB, as the driver does."""

import datetime
import decimal
import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(spark, query, sql, folder=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    other = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert mine == other
    return mine
