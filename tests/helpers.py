"""Comparison of query results with DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.sql(sql)
    columns = list(found.columns)
    return sorted(columns), [dict(zip(columns, r, strict=True)) for r in found.fetchall()]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


def same_rows(df, sql, sf_dir):
    columns, want = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == columns
    have = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    assert have == sorted(([plain(r[c]) for c in columns] for r in want), key=str)
