"""Runs a query and its SQL on the same tables and compares what they give."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, folder: str, query, sql: str) -> int:
    frame = query(spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    found = connect(folder).execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    theirs = rows_of(columns, found.fetchall())
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not wrong, wrong[:3]
    return len(ours)
