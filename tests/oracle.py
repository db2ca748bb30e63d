"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' * os.path.isdir(path)}'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    rows = lambda found, names: sorted(repr([r[names.index(c)] for c in columns]) for r in found)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)
