"""Compares a query with its SQL over the same tables."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def differences(spark, query, sql, folder=DATA):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df, rel = query(spark, folder), con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    said = rel.select(*(f'"{c}"' for c in columns)).fetchall()
    key = lambda r: tuple("" if v is None else repr(v) for v in r)
    return [(a, b) for a, b in zip(sorted(got, key=key), sorted(said, key=key), strict=True) if a != b]
