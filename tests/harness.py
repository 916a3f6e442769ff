"""Run a query in Spark and its check in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

from lexigrid.plans.tables import TABLES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(folder, name)}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if hasattr(value, "as_tuple"):  # Decimal
        return str(int(value)) if value == int(value) else repr(float(value))
    return str(value)


def rows_of(table) -> tuple[list[str], list[tuple]]:
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    return cols, sorted(tuple(_plain(v) for v in row) for row in zip(*data)) if data else []


def compare(spark_table, duck_table) -> str | None:
    """None when the two are equal, else what differs."""
    ac, a = rows_of(spark_table)
    bc, b = rows_of(duck_table)
    if ac != bc:
        return f"columns {ac} against {bc}"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}: {_first(a, b)}"
    if a != b:
        return f"values differ in {sum(x != y for x, y in zip(a, b))} of {len(a)} rows: {_first(a, b)}"
    return None


def _first(a, b):
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"only Spark {only_a}, only SQL {only_b}"
