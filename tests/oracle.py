"""Compares a query with its SQL, run by DuckDB over the same files."""

import datetime
import decimal
import glob
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(x):
    if x is None or x != x:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(" ").removesuffix(" 00:00:00")
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(cell(r[k]) for k in order) for r in data])


def check(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    df = query(spark, DATA)
    got = rows(df.columns, df.collect())
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, res.fetchall())
