"""Compare a query's rows with those of its SQL twin on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x


def canonical(names: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, rows = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, rows)
