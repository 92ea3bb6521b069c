"""Runs a query's SQL in DuckDB and puts both results in one form for comparing."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def run_sql(sql: str, data_dir: str) -> tuple[list[str], list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from read_parquet('{data_dir}/{name}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = [str(d[1]) for d in got.description]
    return names, kinds, got.fetchall()


def normal(names: list[str], rows: list[tuple]) -> list[tuple]:
    """Columns by name and rows in order, each value with its type spelled out."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in at) for r in rows)


SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}
