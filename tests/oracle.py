"""Run an oracle in DuckDB and compare rows without regard to order."""

from __future__ import annotations

import os

import duckdb


def rows_of(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None else f"{float(r[i]):.6f}" if type(r[i]).__name__ in ("float", "Decimal") else str(r[i]) for i in order) for r in rows)


def check(frame, sql: str, folder: str) -> None:
    columns, expected = rows_of(sql, folder)
    assert sorted(frame.columns) == sorted(columns)
    got, want = normal(frame.columns, [tuple(r) for r in frame.collect()]), normal(columns, expected)
    assert len(got) == len(want)
    assert got == want
