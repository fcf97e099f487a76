"""Runs queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

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


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str, con) -> str | None:
    """None if both sides agree, otherwise what differs."""
    frame = query(spark, sf_dir)
    found = rows_of(frame.columns, frame.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = rows_of(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    if len(found) != len(wanted):
        return f"{len(found)} rows vs {len(wanted)}"
    for a, b in zip(found, wanted, strict=True):
        if list(map(type, a)) != list(map(type, b)) or a != b and not _same(a, b):
            return f"{a} vs {b}"
    return None


def _same(a, b) -> bool:
    return all(
        x == y or isinstance(x, float) and math.isnan(x) and math.isnan(y) for x, y in zip(a, b, strict=True)
    )


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from tidemark.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names:
        started = time.time()
        try:
            problem = differences(spark, queries()[name], oracle_sql()[name], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:26s} {time.time() - started:6.1f}s {'ok' if problem is None else problem}", flush=True)
        if problem:
            bad.append(name)
    print("missing oracles:", sorted(set(queries()) - set(oracle_sql())), "failed:", bad)
