"""Compares a query with its SQL, run by DuckDB on the same Parquet files."""

import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def compare(spark, query, sql, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got = query(spark, folder)
    columns = sorted(got.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
    return a
