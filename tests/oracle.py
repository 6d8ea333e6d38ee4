"""Runs a query and its SQL over the same folder and compares the rows."""

import decimal
import math
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        con.execute(f"create view {f.split('.')[0]} as select * from '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    r = con.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, r.fetchall())
