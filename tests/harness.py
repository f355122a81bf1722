"""Runs a query on Spark and its SQL on DuckDB and compares columns, counts and values."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def compare(spark, query, sql: str, sf_dir: str, con=None) -> int:
    cur = (con or connect(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(tuple(str(row[i]) for i in order) for row in cur.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(str(row[c]) for c in sorted(df.columns)) for row in df.collect())
    assert len(got) == len(want)
    assert got == want, [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3]
    return len(got)
