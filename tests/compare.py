"""Run a registered query and its SQL twin, and compare the rows regardless of order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value: object) -> tuple:
    if value is None or isinstance(value, float) and math.isnan(value):
        return (0, "")
    if isinstance(value, float):
        return (1, repr(value))
    return (2, f"{type(value).__name__}:{value}")


def _sorted(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def mismatch(spark_rows, spark_columns: list[str], con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(spark_columns):
        return f"columns {sorted(spark_columns)} against {sorted(columns)}"
    ours, theirs = _sorted(spark_columns, [tuple(r) for r in spark_rows]), _sorted(columns, expected)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(differing)} of {len(ours)} rows differ, first {differing[0]}" if differing else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from parleystat.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    twins = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            table = query(spark, folder)
            rows = table.collect()
            took = time.time() - start
            start = time.time()
            problem = mismatch(rows, table.columns, con, twins[name]) if name in twins else "no twin"
        except Exception as error:  # noqa: BLE001
            took, rows, problem = time.time() - start, [], f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32} {len(rows):7} rows {took:6.2f}s sql {time.time() - start:5.2f}s {problem or ''}", flush=True)
