"""Holds a query's rows against its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    cell = lambda v: "null" if v is None else f"{v:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in zip(*(table.column(n).to_pylist() for n in names)))


def difference(df, con, sql: str) -> str | None:
    got, want = df.toArrow(), con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {got.column_names} {want.column_names}"
    types = {n: (str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in got.column_names}
    if odd := {n: t for n, t in types.items() if t[0].replace("large_", "") != t[1].replace("large_", "")}:
        return f"types {odd}"
    a, b = _rows(got), _rows(want)
    if a != b:
        return f"{len(a)} rows, {len(b)} in SQL; first difference {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
    return None
