"""Compares a query's rows with its DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def same_rows(df, con, sql):
    """Asserts equal columns and equal rows in any order."""
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs
