"""Runs a registered query and its DuckDB equivalent on the same tables and compares their rows."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return [plain(v) for v in value.values()]
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    found = con.execute(sql)
    return sorted_rows([c[0] for c in found.description], found.fetchall())


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    columns, rows = sorted_rows(df.columns, df.collect())
    other_columns, other_rows = duck_rows(sql, sf_dir)
    if columns != other_columns:
        return f"columns {columns} and {other_columns}"
    if rows != other_rows:
        only, missing = sorted(set(rows) - set(other_rows)), sorted(set(other_rows) - set(rows))
        return f"{len(rows)} and {len(other_rows)} rows; only in Spark {str(only[:2])[:400]}; only in SQL {str(missing[:2])[:400]}"
    return ""
