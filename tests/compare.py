"""Run registered queries beside their SQL: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    """A value in a form that compares equal across the two engines."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def differences(spark, connection, query, sql, folder):
    """An empty list when both results agree, else what differs."""
    frame = query(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    left, right = sorted_rows(frame.columns, got), sorted_rows(names, want)
    if len(left) != len(right):
        return [f"{len(left)} rows != {len(right)} rows", f"{left[:2]}", f"{right[:2]}"]
    return [f"{a} != {b}" for a, b in zip(left, right) if a != b][:3]


def main() -> None:
    from passel.session import local_session
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if name in oracles:
                found = differences(spark, connection, query, oracles[name], folder)
                state = "ok" if not found else "DIFFERS"
            else:
                found, state = [], f"no sql, {query(spark, folder).count()} rows"
        except Exception as error:  # noqa: BLE001
            found, state = [str(error)[:700]], "ERROR"
        bad += bool(found)
        print(f"{name:34s} {state} {time.time() - started:.2f}s", flush=True)
        for line in found:
            print("    ", line[:700])
    print("bad:", bad)


if __name__ == "__main__":
    main()
