"""Run registered queries in Spark and their SQL in DuckDB, and compare.

    python tests/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def compare(spark, connection, name: str, build, sql: str, folder: str) -> str | None:
    """None if both sides agree, else what differs."""
    ours = build(spark, folder)
    names = sorted(ours.columns)
    left_rows = ours.select(*names).collect()
    relation = connection.sql(sql)
    theirs = dict(zip(relation.columns, [str(kind) for kind in relation.types]))
    if sorted(theirs) != names:
        return f"columns {names} / {sorted(theirs)}"
    kinds = dict(ours.dtypes)
    drift = [f"{n}: {kinds[n]}/{theirs[n]}" for n in names if TYPES.get(kinds[n]) != theirs[n]]
    right_rows = relation.project(", ".join(f'"{n}"' for n in names)).fetchall()
    left = sorted(map(repr, map(tuple, left_rows)))
    right = sorted(map(repr, right_rows))
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    if left != right:
        pair = next((a, b) for a, b in zip(left, right) if a != b)
        return f"values differ in {sum(a != b for a, b in zip(left, right))} of {len(left)}\n   {pair[0][:700]}\n   {pair[1][:700]}"
    return f"types {drift}" if drift else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from logweir.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = connect(folder), oracle_sql(), 0
    for name, build in queries().items():
        if args.names and not any(name.startswith(wanted) for wanted in args.names):
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, connection, name, build, oracles[name], folder)
            else:
                problem = None if build(spark, folder).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:32} {time.time() - started:6.2f}s {'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
