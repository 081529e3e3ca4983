"""Holds a Spark result against SQL that DuckDB runs over the same rows."""

import math

import duckdb


def connect(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    return con


def plain(value):
    return float(f"{value:.12g}") if isinstance(value, float) and not math.isnan(value) else value


def same(df, con, sql):
    names = sorted(df.columns)
    want = con.execute(sql)
    assert sorted(d[0] for d in want.description) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == expected
    return len(got)
