"""Runs registered queries against DuckDB on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bytes | bytearray | memoryview):
        return bytes(v).hex()
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def compare(spark, folder, query, sql):
    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{files}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    result = db.execute(sql)
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == names
    want = sorted((tuple(plain(r[at[n]]) for n in names) for r in result.fetchall()), key=repr)
    assert got == want
