"""Compare registered queries with their SQL statements on one data folder.

Run as a script: ``python tests/compare.py FOLDER [NAME ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(spark, con, name: str, folder: str) -> str | None:
    """None when names, row count and values agree, else what differs."""
    df = queries()[name](spark, folder)
    ours = _sorted_rows(df.columns, df.collect())
    result = con.execute(oracle_sql()[name])
    theirs = _sorted_rows([c[0] for c in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows against {len(theirs[1])}"
    for mine, other in zip(ours[1], theirs[1]):
        if mine != other:
            return f"{mine} against {other}"
    return None


def main(folder: str, names: list[str]) -> None:
    from scimetrics.session import spark_session

    spark = spark_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names or oracle_sql():
        started = time.time()
        try:
            found = difference(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - started:6.1f}s  {found or 'ok'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
