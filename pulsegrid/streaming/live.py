"""Streaming forms of the rollup, of deduplication and of the trailing hour."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pulsegrid.functions.exact import exact_sum
from pulsegrid.functions.timeaxis import MS_PER_HOUR
from pulsegrid.operators.synthesis import merge_partials, partials, synthesis_of
from pulsegrid.schema import ROLLUP
from pulsegrid.storage.layout import read_folder
from pulsegrid.storage.store import Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark) -> None:
    """Keep streaming state on local disk with changelog checkpoints, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def windowed_rollup(messages: DataFrame) -> DataFrame:
    """One-second partials as a stateful aggregation, for ``update`` output.

    No watermark: a row of any age updates its second. State grows with the
    number of seconds; the store's partial rows are the form without state.
    """
    window = F.window(F.timestamp_millis("ts_ms"), "1 second")
    return (
        messages.groupBy(window.alias("window"), "sensor_type")
        .agg(
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            exact_sum("value").alias("total"),
            F.count("value").alias("cnt"),
        )
        .withColumn("bucket", F.unix_seconds("window.start"))
        .drop("window")
    )


def unique_stream(messages: DataFrame, delay: str | None = None) -> DataFrame:
    """The first message of each id to arrive.

    Ids are kept for good, or with ``delay`` for that long after they arrived: then their
    state is dropped. Time of arrival, not of the event, so no message is too late: an old
    one with a new id passes. Before the shuffle each Arrow batch of an input partition
    keeps one row an id, without state, so an id that fills a third of the stream sends a
    row a batch, and the state has one entry an id.
    """
    reduced = messages.mapInArrow(_first_of_batch, messages.schema)
    if delay is None:
        return reduced.dropDuplicates(["id"])
    timed = reduced.withColumn("_ts", F.current_timestamp()).withWatermark("_ts", delay)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("_ts")


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("id").dictionary_encode().indices.fill_null(-1).to_numpy()
        yield batch.take(pa.array(np.sort(np.unique(codes, return_index=True)[1])))


def trailing_hour_writer(store: Store, folder: str) -> Callable[[int], None]:
    """For ``after_commit``: writes the synthesis of the hour up to the newest
    message to ``folder/batch_id=N``."""

    def write(batch_id: int) -> None:
        # One row per sensor: a single small file.
        store.trailing_hour().coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/batch_id={batch_id}"
        )

    return write


class TrailingHour:
    """A sink for ``also`` of ``load_batch``: the synthesis of the hour up to the newest
    message, written to ``folder/answers/batch_id=N``, without reading the store.

    The state is the last hour's partials by millisecond and sensor, whatever the number of
    messages. It is written with every batch to one of two folders in turn, so a repeated
    batch starts from the same state. With ``clock_ms`` the hour does not end after that
    time: messages dated later wait in the state until it comes, and one dated 9999 does
    not empty the answers.
    """

    def __init__(self, spark: SparkSession, folder: str, clock_ms: Callable[[], int] | None = None):
        self.spark, self.folder, self.clock_ms = spark, folder.rstrip("/"), clock_ms

    def _state(self, batch_id: int) -> DataFrame:
        # The folder may hold the state of two batches before: that of another batch is none.
        rows = read_folder(self.spark, f"{self.folder}/state/slot={batch_id % 2}", self._COLUMNS, "batch_id")
        return rows.filter(F.col("batch_id") == batch_id).drop("batch_id")

    # As the rollup, by millisecond.
    _COLUMNS = StructType([StructField("ts_ms", LongType()), *[f for f in ROLLUP.fields if f.name not in ("bucket", "event_date")]])

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        fresh = partials(rows, "ts_ms", "sensor_type")
        merged = merge_partials(fresh.unionByName(self._state(batch_id - 1)), "ts_ms", "sensor_type")
        newest = merged.agg(F.max("ts_ms")).first()[0]
        if newest is not None:
            end = newest if self.clock_ms is None else min(newest, self.clock_ms())
            kept = merged.filter(F.col("ts_ms") >= end - MS_PER_HOUR)
        else:
            end, kept = 0, merged
        kept.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{self.folder}/state/slot={batch_id % 2}"
        )
        state = self._state(batch_id).filter(F.col("ts_ms") <= end)
        # One row per sensor: a single small file.
        synthesis_of(state).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/answers/batch_id={batch_id}")
