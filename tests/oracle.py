"""Compare a query with its SQL twin: same columns, same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(data: Path = DATA) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql: str, data: Path = DATA) -> None:
    found = database(data).execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
    assert len(ours) == len(theirs)
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not different, different[:3]
