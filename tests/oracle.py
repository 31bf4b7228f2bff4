"""Comparing a registered query with its SQL on the same Parquet files."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def run_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for table in TABLES:
        file = f"{sf_dir}/{table}.parquet"
        if os.path.exists(file):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{file}')")
    result = connection.execute(sql)
    return [column[0] for column in result.description], result.fetchall()


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs between a DataFrame and the SQL; empty if nothing does."""
    names, expected = run_sql(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    found = sorted((tuple(row[name] for name in order) for row in df.collect()), key=repr)
    places = [names.index(name) for name in order]
    wanted = sorted((tuple(row[i] for i in places) for row in expected), key=repr)
    if len(found) != len(wanted):
        return [f"{len(found)} rows != {len(wanted)}"] + _first(found, wanted, order)
    return _first(found, wanted, order) if found != wanted else []


def _first(found: list, wanted: list, order: list[str]) -> list[str]:
    extra = sorted(set(map(repr, found)) - set(map(repr, wanted)))[:3]
    missing = sorted(set(map(repr, wanted)) - set(map(repr, found)))[:3]
    return [f"columns {order}"] + [f"+ {row}" for row in extra] + [f"- {row}" for row in missing]
