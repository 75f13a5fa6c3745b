"""Runs a query and its SQL over the same tables."""

import math
from pathlib import Path

import duckdb


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)


def compare(spark, query, sql, folder):
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, result.fetchall())
    assert got == want
    return len(got)
