"""Runs SQL over the test tables and compares rows."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns by name, in an order of their own; floats that are whole numbers of 10^-9 alike."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    tell = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(tuple(tell(r[i]) for i in at) for r in rows)


def expected(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    table = con.execute(sql).to_arrow_table()
    return sorted(table.column_names), canonical(table.column_names, list(zip(*[c.to_pylist() for c in table.columns])))


def found(df) -> tuple[list[str], list[tuple]]:
    table = df.toArrow()
    return sorted(table.column_names), canonical(table.column_names, list(zip(*[c.to_pylist() for c in table.columns])))
