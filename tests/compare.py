"""Holds a Spark result against DuckDB SQL on the same files."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con


def plain(x):
    """A value that compares alike from either side."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, dict):
        return sorted((plain(k), plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, sql: str, sf_dir: str) -> str | None:
    """What differs, null if nothing does."""
    con = duck(sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows_of(names, got.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(have):
        return f"{len(have)} rows, SQL has {len(want)}"
    for a, b in zip(have, want, strict=True):
        if a != b:
            return f"row {a} where SQL has {b}"
    return None
