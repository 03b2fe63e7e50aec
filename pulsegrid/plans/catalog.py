"""What a registered query consists of."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    """A query over the test tables and, where SQL can say it, the same in SQL."""

    run: Run
    sql: str | None = None


# The SQL forms of the fixtures in ``pulsegrid.sources.tables``. DuckDB's
# epoch_ms(timestamp) rounds microseconds; event time is cut to the millisecond.

MESSAGES_SQL = """
messages AS (
  SELECT *, ts_ms // 1000 AS bucket, CAST(epoch_ms(ts_ms) AS DATE) AS event_date
  FROM (SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq,
               CAST(user_id % 10 + 1 AS INTEGER) AS sensor_type,
               CAST(round(value * 100) AS BIGINT) AS value
        FROM events))"""

SHIPMENTS_SQL = """
shipments AS (
  SELECT *, ts_ms // 1000 AS bucket, CAST(epoch_ms(ts_ms) AS DATE) AS event_date
  FROM (SELECT l_orderkey || '-' || l_linenumber AS id, epoch_us(l_shipdate) // 1000 AS ts_ms,
               l_partkey * 1000000 + l_suppkey AS seq,
               CAST(l_suppkey % 10 + 1 AS INTEGER) AS sensor_type,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS value
        FROM lineitem))"""

REQUESTS_SQL = """
requests AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS request_id, o_orderstatus AS status, start AS from_ms,
         start + o_custkey % 7200 * 1000 AS to_ms
  FROM (SELECT *, o_orderkey * 7919017 % 2505600000 + 1704067200000 AS start FROM orders))"""

MESSAGE_COLUMNS = "id, ts_ms, seq, sensor_type, value, bucket, event_date"


def average_sql(total: str = "total", cnt: str = "cnt") -> str:
    """Exact two-decimal average of integers, halves away from zero."""
    return (
        f"CAST(CAST({total} // {cnt} AS DECIMAL(20,0)) + sign({total}) * "
        f"CAST((200 * abs({total} % {cnt}) + {cnt}) // (2 * {cnt}) AS DECIMAL(20,0)) * 0.01 "
        f"AS DECIMAL(21,2))"
    )


def rounded_average_sql(total: str = "total", cnt: str = "cnt") -> str:
    """Whole-number average of integers, halves up."""
    doubled = f"(2 * {total} + {cnt})"
    return (
        f"CAST({doubled} // (2 * {cnt}) - "
        f"CASE WHEN {doubled} % (2 * {cnt}) < 0 THEN 1 ELSE 0 END AS BIGINT)"
    )


def synthesis_sql(rows: str, keys: str = "sensor_type") -> str:
    """Answer over ``rows`` (a table with an optional WHERE clause)."""
    return f"""
SELECT {keys}, min_value, max_value, {average_sql()} AS medium_value, cnt AS count
FROM (SELECT {keys}, min(value) AS min_value, max(value) AS max_value,
             sum(value) AS total, count(*) AS cnt
      FROM {rows} GROUP BY {keys})"""


def rollup_sql(rows: str) -> str:
    return f"""
SELECT bucket, sensor_type, min(value) AS min_value, max(value) AS max_value,
       CAST(sum(value) AS DECIMAL(38,0)) AS total, count(*) AS cnt, event_date
FROM {rows} GROUP BY bucket, sensor_type, event_date"""


def requests_sql(source: str) -> str:
    """Answers to every row of ``source (request_id, from_ms, to_ms)``."""
    covered = (
        f"(SELECT request_id, sensor_type, value FROM {source} r "
        f"JOIN messages m ON m.ts_ms >= r.from_ms AND m.ts_ms <= r.to_ms)"
    )
    return synthesis_sql(covered, "request_id, sensor_type")
