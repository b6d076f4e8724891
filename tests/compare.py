"""Run queries against their SQL in DuckDB: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return value.date()
    return value


def _sorted_rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(result, connection, sql: str) -> str | None:
    """What differs between a Spark result and the SQL's, in one line."""
    relation = connection.sql(sql)
    expected = _sorted_rows(relation.columns, relation.fetchall())
    actual = _sorted_rows(result.columns, [tuple(r) for r in result.collect()])
    if expected[0] != actual[0]:
        return f"columns {actual[0]} instead of {expected[0]}"
    if len(expected[1]) != len(actual[1]):
        return f"{len(actual[1])} rows instead of {len(expected[1])}"
    for got, want in zip(actual[1], expected[1]):
        if got != want:
            return f"row {got} instead of {want}"
    return None


def main() -> None:
    import __spark_entry__ as entry

    from pricing_engine.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles = connect(sf_dir), entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            result = query(spark, sf_dir)
            if name in oracles:
                problem = difference(result, connection, oracles[name])
                n_rows = len(connection.sql(oracles[name]).fetchall())
            else:
                n_rows, problem = result.count(), None
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n_rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        failed += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{name:32} {kind:4} {n_rows:8} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
