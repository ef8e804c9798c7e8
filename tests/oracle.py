"""Runs registered queries and their SQL on the same tables and compares rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def rows(names: list[str], data) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    fix = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(str([fix(r[i]) for i in order]) for r in data)


def compare(spark, name: str, query, sql: str, con, sf_dir: str) -> str:
    """An empty string where both agree on columns and rows."""
    df = query(spark, sf_dir)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    a, b = rows(df.columns, got), rows(names, want)
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; {only}"
    return "" if a else "no rows"
