"""Runs a query's SQL twin in DuckDB and compares the rows."""

import glob
import math
import os
from pathlib import Path

import duckdb


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if os.path.isdir(p) else str(p)
        if glob.glob(src):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float)) else (True, "", x) for x in r))


def assert_same(spark_df, sf_dir: str, sql: str) -> int:
    want_c, want = table(*duck(sf_dir, sql))
    got_c, got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert got_c == want_c
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (got_c, len(bad), bad[:3])
    return len(got)
