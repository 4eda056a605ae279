"""Holds a Spark result against DuckDB's on the same tables."""

import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(sf_dir=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def same_rows(df, con, sql):
    """Raises unless both have the same columns and rows, in any order."""
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    got = sorted(tuple(map(plain, row)) for row in df.select(*columns).collect())
    assert got == want
    return len(got)
