"""Runs a registered query and its SQL on the same tables, and compares the rows."""

import math
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def compare(spark, con, query, sql, sf_dir):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names, (sorted(columns), names)
    theirs = sorted((tuple(plain(dict(zip(columns, r, strict=True))[n]) for n in names) for r in result.fetchall()), key=repr)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (a, b)
    return len(ours)
