"""Compares registered queries with their SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return list(map(_plain, value)) if isinstance(value, (list, tuple)) else value


def rows(columns: list[str], records) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, db, sql: str) -> None:
    found = db.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert len(mine) == len(theirs)
    odd = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not odd, odd[:5]
