"""Compares a query with its DuckDB SQL over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def oracle_rows(sql, folder, views=None):
    con = duckdb.connect()
    for t in TABLES:
        if views and t in views:
            con.register(f"{t}_frame", views[t])
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM {t}_frame")
        elif folder:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def assert_same(df, sql, folder, views=None):
    names, rows = oracle_rows(sql, folder, views)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in places) for r in rows), key=repr)
    assert got == want
