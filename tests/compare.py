"""Runs a query's SQL in DuckDB and compares rows as multisets."""

import glob
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def duck_rows(sql, folder=SMALL):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from read_parquet('{path}')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return names, rel.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: "nan" if isinstance(v, float) and v != v else repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return sorted(names), sorted([tuple(text(r[i]) for i in order) for r in rows])


def assert_same(df, sql, folder=SMALL):
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(*duck_rows(sql, folder))
