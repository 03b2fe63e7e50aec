"""Run registered queries next to their SQL in DuckDB and compare all rows.

    python tests/check_oracles.py [SF_DIR] [QUERY ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def bag(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, sf_dir: str, name: str) -> tuple[bool | None, str]:
    """(equal, note); equal is None for queries without SQL."""
    result = entry_module.queries()[name](spark, sf_dir)
    got = bag(result.columns, [tuple(row) for row in result.collect()])
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return None, f"{len(got)} rows, no SQL"
    cursor = duck(sf_dir).execute(sql)
    columns = [part[0] for part in cursor.description]
    want = bag(columns, cursor.fetchall())
    if sorted(columns) != sorted(result.columns):
        return False, f"columns {sorted(result.columns)} != {sorted(columns)}"
    if got != want:
        differing = [pair for pair in zip(got, want) if pair[0] != pair[1]][:2]
        return False, f"{len(got)} rows against {len(want)}: {differing}"
    return True, f"{len(got)} rows"


def main() -> int:
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry_module.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        started = time.time()
        try:
            equal, note = compare(spark, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            equal, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += equal is False
        verdict = {True: "ok", False: "FAIL", None: "--"}[equal]
        print(f"{verdict:4} {name:30} {time.time() - started:6.1f}s  {note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
