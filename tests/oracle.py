"""Comparison of a query's rows with those that DuckDB gives for its SQL."""

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(columns, data):
    def plain(v):
        assert not isinstance(v, Decimal), "a query's numbers are doubles or longs"
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows([d[0] for d in cur.description], cur.fetchall())
    assert left[0] == right[0]
    assert len(left[1]) == len(right[1])
    assert left[1] == right[1]
