"""Registered queries that first write the messages to a store, then read it.

Each run gets a fresh store in the session's shared folder.
"""

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.plans.batch import FROM_MS, TO_MS
from pulsegrid.plans.catalog import (
    MESSAGE_COLUMNS,
    MESSAGES_SQL,
    REQUESTS_SQL,
    Query,
    requests_sql,
    rollup_sql,
    synthesis_sql,
)
from pulsegrid.session import workspace
from pulsegrid.sources import tables
from pulsegrid.storage.store import Store

# Two batches; the second is older than the first and partly hits sealed days.
LATE_BEFORE = date(2024, 1, 10)
# Day bounds of the two seals.
FIRST_SEAL, SECOND_SEAL = date(2024, 1, 16), date(2024, 1, 21)

# Within a second, seconds, minutes to hours, across a month's days, up to the newest day.
_T = 1_704_868_215_250
BLOCK_RANGES = [
    (_T, _T + 400),
    (_T, _T + 59_000),
    (_T, _T + 5_400_000),
    (_T, _T + 9 * 86_400_000),
    (1_704_844_800_000, 1_705_104_000_000),
    (1_704_000_000_000, 1_710_000_000_000),
]


def _fresh(spark: SparkSession) -> Store:
    return Store(spark, workspace(spark, "store"))


def _in_two_batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows, days = tables.messages(spark, sf_dir), F.col("event_date")
    return rows.filter(days >= F.lit(LATE_BEFORE)), rows.filter(days < F.lit(LATE_BEFORE))


def loaded_store(spark: SparkSession, sf_dir: str) -> Store:
    """All messages in two batches; repeating one of them changes nothing."""
    store = _fresh(spark)
    for batch_id, rows in enumerate(_in_two_batches(spark, sf_dir)):
        store.append(rows, batch_id)
        store.append(rows, batch_id)
    return store


def sealed_store(spark: SparkSession, sf_dir: str, layout: str = "time") -> Store:
    """All messages; days sealed, then reached by late rows, then sealed again."""
    store = _fresh(spark)
    recent, late = _in_two_batches(spark, sf_dir)
    store.append(recent, 0)
    store.seal(FIRST_SEAL, layout)
    store.append(late, 1)
    store.seal(SECOND_SEAL, layout)
    return store


def _messages(spark, sf_dir):
    return loaded_store(spark, sf_dir).messages()


def _messages_in_range(spark, sf_dir):
    return sealed_store(spark, sf_dir).messages(FROM_MS, TO_MS)


def _rollup(spark, sf_dir):
    return loaded_store(spark, sf_dir).rollup()


def _sealed_messages(spark, sf_dir):
    return sealed_store(spark, sf_dir).messages()


def _sensor_layout(spark, sf_dir):
    return sealed_store(spark, sf_dir, "sensor").messages()


def _sealed_rollup(spark, sf_dir):
    return sealed_store(spark, sf_dir).rollup()


def _synthesis(spark, sf_dir):
    return sealed_store(spark, sf_dir).synthesis(FROM_MS, TO_MS)


def _synthesis_days(spark, sf_dir):
    """Ranges of every length, each answered from the fewest blocks of the rollup levels."""
    now = sealed_store(spark, sf_dir).snapshot()
    parts = [
        now.synthesis(start, end).withColumn("part", F.lit(k).cast("int"))
        for k, (start, end) in enumerate(BLOCK_RANGES)
    ]
    return reduce(DataFrame.unionByName, parts)


def _requests(spark, sf_dir):
    return sealed_store(spark, sf_dir).synthesis_requests(tables.requests(spark, sf_dir))


def _count(spark, sf_dir):
    return sealed_store(spark, sf_dir).count()


def _retention(spark, sf_dir):
    """Sealed days and late rows before ``LATE_BEFORE`` are dropped by a further seal."""
    store = sealed_store(spark, sf_dir)
    store.seal(SECOND_SEAL, keep_from=LATE_BEFORE)
    return store.messages()


def _retention_late_rows(spark, sf_dir):
    """Rows that come for dropped days after the drop stay away, sealed again or not."""
    store = _fresh(spark)
    recent, late = _in_two_batches(spark, sf_dir)
    store.append(recent, 0)
    store.seal(FIRST_SEAL, keep_from=LATE_BEFORE)
    store.append(late, 1)
    store.seal(SECOND_SEAL)
    return store.messages()


def _removed(spark, sf_dir):
    """What a second seal supersedes is deleted; the same rows are read from what is left."""
    store = sealed_store(spark, sf_dir)
    store.remove_superseded(timedelta(0))
    store.append(_in_two_batches(spark, sf_dir)[0], 0)
    return store.messages()


def _out_of_order(spark, sf_dir):
    """A lower batch id after a higher one is sealed."""
    store = _fresh(spark)
    recent, late = _in_two_batches(spark, sf_dir)
    store.append(recent, 5)
    store.seal(FIRST_SEAL)
    store.append(late, 3)
    store.append(recent, 5)
    return store.messages()


def _ids_known(spark, sf_dir):
    """Order lines and events probed by id against a sealed store: those that are stored."""
    stored = sealed_store(spark, sf_dir).ids()
    asked = tables.messages(spark, sf_dir).select("id").unionByName(tables.shipments(spark, sf_dir).select("id"))
    return stored.known(asked)


def _ids_new(spark, sf_dir):
    """Ids of which half are stored, probed while some days are sealed and others not."""
    stored = sealed_store(spark, sf_dir).ids()
    other = F.when(F.col("seq") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("-x")))
    return stored.unknown(tables.messages(spark, sf_dir).select(other.alias("id")))


def _fan_out(spark, sf_dir):
    """A second table fed by the same batches as the store's own."""
    store = _fresh(spark)
    copy = f"{store.root}/copy"

    def sink(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{copy}/batch_id={batch_id}")

    for batch_id, rows in enumerate(_in_two_batches(spark, sf_dir)):
        store.append(rows, batch_id, also=[sink])
    return spark.read.parquet(copy).drop("batch_id")


_ALL = f"WITH {MESSAGES_SQL} SELECT {MESSAGE_COLUMNS} FROM messages"
_IN_RANGE = f"ts_ms BETWEEN {FROM_MS} AND {TO_MS}"
_ROLLUP = f"WITH {MESSAGES_SQL} {rollup_sql('messages')}"

QUERIES = {
    "store_messages": Query(_messages, _ALL),
    "store_messages_range": Query(_messages_in_range, f"{_ALL} WHERE {_IN_RANGE}"),
    "store_rollup": Query(_rollup, _ROLLUP),
    "store_sealed_messages": Query(_sealed_messages, _ALL),
    "store_sensor_layout": Query(_sensor_layout, _ALL),
    "store_sealed_rollup": Query(_sealed_rollup, _ROLLUP),
    "store_synthesis": Query(
        _synthesis, f"WITH {MESSAGES_SQL} {synthesis_sql(f'messages WHERE {_IN_RANGE}')}"
    ),
    "store_synthesis_blocks": Query(
        _synthesis_days,
        f"WITH {MESSAGES_SQL} "
        + " UNION ALL ".join(
            f"SELECT *, {k} AS part FROM ({synthesis_sql(f'messages WHERE ts_ms BETWEEN {start} AND {end}')})"
            for k, (start, end) in enumerate(BLOCK_RANGES)
        ),
    ),
    "store_synthesis_requests": Query(
        _requests, f"WITH {MESSAGES_SQL}, {REQUESTS_SQL} {requests_sql('requests')}"
    ),
    "store_message_count": Query(
        _count, "SELECT CAST(count(*) AS BIGINT) AS messages FROM events"
    ),
    "store_retention": Query(_retention, f"{_ALL} WHERE event_date >= DATE '{LATE_BEFORE}'"),
    "store_retention_late_rows": Query(
        _retention_late_rows, f"{_ALL} WHERE event_date >= DATE '{LATE_BEFORE}'"
    ),
    "store_removed": Query(_removed, _ALL),
    "store_out_of_order_batches": Query(_out_of_order, _ALL),
    "store_ids_known": Query(
        _ids_known, "SELECT CAST(event_id AS VARCHAR) AS id FROM events"
    ),
    "store_ids_new": Query(
        _ids_new, "SELECT CAST(event_id AS VARCHAR) || '-x' AS id FROM events WHERE event_id % 2 <> 0"
    ),
    "store_fan_out": Query(_fan_out, _ALL),
}
