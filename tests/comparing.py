"""Comparison of a query with its SQL in DuckDB, rows without order."""

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connection():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def differs(spark, con, query, sql):
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    result = con.sql(sql)
    at = [result.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=str)
    return [(a, b) for a, b in zip(ours, theirs) if a != b][:3] or (len(ours) != len(theirs) and (len(ours), len(theirs)))
