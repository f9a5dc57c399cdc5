"""Holds a query's rows against its SQL in DuckDB."""

import math
from pathlib import Path

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return repr(float(v))


def compare(spark, query, sql):
    got = query(spark, str(SF))
    names = sorted(got.columns)
    rel = duck().sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == want
