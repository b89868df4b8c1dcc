"""Compare Spark results with an in-process DuckDB over the same parquet files."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_normal(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when names, kinds and rows agree."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = bag(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    actual = bag(df.columns, [tuple(r) for r in df.collect()])
    if not expected:
        return "the oracle returned no rows"
    if actual == expected:
        return ""
    extra, lacking = actual - expected, expected - actual
    return (
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; "
        f"extra {list(extra.items())[:3]}; missing {list(lacking.items())[:3]}"
    )
