"""Compares a query with its SQL, whatever the order of rows."""

from pathlib import Path

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return v


def rows(columns, data):
    return sorted((tuple(value(r[columns.index(c)]) for c in sorted(columns)) for r in data), key=repr)


def assert_same(con, sql, df):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows(names, cursor.fetchall())
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(expected)
    assert got == expected
