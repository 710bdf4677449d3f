"""Run registered queries in Spark and DuckDB and compare the rows: ``python -m checks.compare DIR [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from checks import oracle, queries
from listingmart.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value: object) -> object:
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.date().isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(names: list[str], table: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in table), key=repr)


def differences(
    columns: list[str], collected: list[tuple], con: duckdb.DuckDBPyConnection, sql: str
) -> list[str]:
    """Empty when columns and rows agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows(names, cursor.fetchall())
    if sorted(columns) != sorted(names):
        return [f"columns {sorted(columns)} != {sorted(names)}"]
    found = rows(columns, collected)
    if len(found) != len(expected):
        return [f"{len(found)} rows, expected {len(expected)}"]
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    return [f"{len(wrong)} of {len(found)} rows differ, first: {wrong[0]}"] if wrong else []


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session("compare")
    con = connect(sf_dir)
    sql = oracle.statements()
    failed = 0
    for name, query in queries.registered().items():
        if names and name not in names:
            continue
        start, took = time.time(), 0.0
        try:
            df = query(spark, sf_dir)
            collected = [tuple(r) for r in df.collect()]
            took = time.time() - start
            problems = differences(df.columns, collected, con, sql[name])
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {took:6.2f}s {name} {' '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
