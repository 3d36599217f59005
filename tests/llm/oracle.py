"""Compare a query with its DuckDB SQL over one folder of tables."""

import os

import duckdb


def duck(sql, sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def assert_agrees(df, sql, sf_dir):
    columns, rows = duck(sql, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=repr)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
