"""Compares a query with its DuckDB statement on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        if os.path.exists(at):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')" if os.path.isfile(at) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet({sorted(glob.glob(at + '/*.parquet'))})")
    return con


def show(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert mine[0] == theirs[0], (mine[0], theirs[0])
    assert len(mine[1]) == len(theirs[1]), (len(mine[1]), len(theirs[1]))
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(mine[1])
