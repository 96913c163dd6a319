"""Compare a query with its DuckDB text over the same tables."""

import os

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: str(round(x, 9)) if isinstance(x, float) else str(x)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def assert_same(spark, folder, query, text):
    got = query(spark, folder)
    want = connect(folder).sql(text)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
