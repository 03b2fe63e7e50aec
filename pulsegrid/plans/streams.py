"""Registered queries that read the tables as streams.

A run writes the messages as a log of JSON lines to the session's shared folder,
streams the log in several micro-batches, and reads what came of it.
"""

import time
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.timeaxis import MS_PER_HOUR
from pulsegrid.operators.identity import evict_persisted, upsert_last
from pulsegrid.plans.catalog import (
    MESSAGES_SQL,
    SHIPMENTS_SQL,
    Query,
    rollup_sql,
    synthesis_sql,
)
from pulsegrid.plans.stored import LATE_BEFORE
from pulsegrid.session import workspace
from pulsegrid.sources import tables
from pulsegrid.storage.store import Store
from pulsegrid.streaming.ingest import AVAILABLE_NOW, backlog_rows, flush, text_stream
from pulsegrid.streaming.hot import HotTable
from pulsegrid.streaming.live import (
    TrailingHour,
    trailing_hour_writer,
    unique_stream,
    use_rocksdb_state,
    windowed_rollup,
)

FILES_PER_BATCH = 3
# A task writes one file: large tables arrive in more files, of about so many rows, and in as
# many batches as small ones.
ROWS_PER_FILE = 500_000


def _times_more_files(rows: int, files: int) -> int:
    """How many times ``files`` it takes for files of ROWS_PER_FILE."""
    return max(-(-rows // (files * ROWS_PER_FILE)), 1)


class _Run:
    """A log, a store fed from it and the checkpoint between them."""

    def __init__(self, spark: SparkSession, root: str | None = None, stream_id: str = "log"):
        self.spark = spark
        self.folder = workspace(spark, "stream")
        self.log = f"{self.folder}/log"
        self.store = Store(spark, root or f"{self.folder}/store", stream_id=stream_id)
        self.times = 1

    def arrive(
        self, raw: DataFrame, files: int | None = None, rows: int = 0, padding: int = 0, codec: str = "none"
    ) -> "_Run":
        """``rows`` tells the size of a table that may be large; its lines get ``padding``
        blanks on their way to the files. Files of a ``codec`` are read whole by one task."""
        # Several files even from a small table, so that there are several batches.
        files = files or self.spark.sparkContext.defaultParallelism
        self.times = _times_more_files(rows, files)
        dealt = raw.repartition(files * self.times)
        if padding:
            dealt = dealt.select(F.concat("raw", F.repeat(F.lit(" "), padding)).alias("raw"))
        dealt.write.mode("append").option("compression", codec).text(self.log)
        return self

    def ingest(self, max_files: int | None = FILES_PER_BATCH, **options) -> "_Run":
        raw = text_stream(self.spark, self.log, max_files and max_files * self.times)
        flush(self.store, raw, f"{self.folder}/checkpoint", **options)
        return self


def _ingested(spark: SparkSession, sf_dir: str, **options) -> _Run:
    raw = tables.raw_json(tables.messages(spark, sf_dir))
    return _Run(spark).arrive(raw).ingest(**options)


def _rollup(spark, sf_dir):
    return _ingested(spark, sf_dir).store.rollup()


def _late_rows(spark, sf_dir):
    """The newer days first, then on the same checkpoint the older ones."""
    rows, days = tables.messages(spark, sf_dir), F.col("event_date")
    run = _Run(spark)
    run.arrive(tables.raw_json(rows.filter(days >= F.lit(LATE_BEFORE)))).ingest()
    run.ingest()
    run.arrive(tables.raw_json(rows.filter(days < F.lit(LATE_BEFORE)))).ingest()
    return run.store.rollup()


def _two_checkpoints(spark, sf_dir):
    """Two sources, each with its own checkpoint and stream id, into one store."""
    rows, days = tables.messages(spark, sf_dir), F.col("event_date")
    first = _Run(spark).arrive(tables.raw_json(rows.filter(days >= F.lit(LATE_BEFORE)))).ingest()
    second = _Run(spark, first.store.root, "backfill")
    second.arrive(tables.raw_json(rows.filter(days < F.lit(LATE_BEFORE)))).ingest()
    return first.store.rollup()


def _restarted(spark, sf_dir):
    """The log arrives in two parts; each is drained by a query of its own on one
    checkpoint, and a third one finds nothing new."""
    rows = tables.messages(spark, sf_dir)
    run = _Run(spark)
    for part in (0, 1):
        run.arrive(tables.raw_json(rows.filter(F.col("seq") % 2 == part))).ingest()
    return run.ingest().store.rollup()


def _twice(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every event as text, and an earlier-dated repetition of it."""
    rows = tables.messages(spark, sf_dir)
    earlier = rows.withColumn("ts_ms", F.col("ts_ms") - MS_PER_HOUR)
    return tables.raw_json(rows), tables.raw_json(earlier)


_STORED = ["id", "ts_ms", "sensor_type", "value", "bucket", "event_date"]


def _any_split(spark, sf_dir):
    """Every event and then its repetition, once in one batch and once in several: the first
    to arrive stays."""
    first, again = _twice(spark, sf_dir)
    rows = first.count()
    whole = _Run(spark).arrive(first, rows=rows).arrive(again, rows=rows).ingest(max_files=None, unique_ids=True)
    parts = _Run(spark).arrive(first, rows=rows).ingest(unique_ids=True)
    parts.arrive(again, rows=rows).ingest(unique_ids=True)
    return whole.store.messages().select(_STORED).unionAll(parts.store.messages().select(_STORED))


def _unlike_files(spark, sf_dir):
    """Older small files and newer ones many times their size, in one batch: Spark deals large
    files out first, yet the rows of the older ones stay, and the newer ones are turned away."""
    first, again = _twice(spark, sf_dir)
    times = _times_more_files(first.count(), 2)
    # As plain text the blanks would take 2 kB a row; as lz4 a newer file still is many times
    # the size of an older one.
    run = _Run(spark).arrive(first, files=16 * times, codec="lz4")
    run.arrive(again, files=2 * times, padding=2_000, codec="lz4")
    run.ingest(max_files=None, unique_ids=True)
    batches = run.store.commits().agg(F.count(F.lit(1)).alias("batches"))
    return run.store.messages().select(_STORED).join(F.broadcast(batches))


def _arrival_order(spark, sf_dir):
    """``seq`` rises from file to file, by their age, whatever their sizes."""
    rows, days = tables.messages(spark, sf_dir), F.col("event_date")
    run = _Run(spark)
    for older in (True, False):
        part = rows.filter((days < F.lit(LATE_BEFORE)) if older else (days >= F.lit(LATE_BEFORE)))
        text = tables.raw_json(part)
        run.arrive(text if older else text.select(F.concat("raw", F.repeat(F.lit(" "), 500)).alias("raw")), files=9 if older else 2)
    stored = run.ingest(max_files=None).store.messages()
    older = days < F.lit(LATE_BEFORE)
    return stored.agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_distinct("seq").alias("numbers"),
        F.coalesce(F.max(F.when(older, F.col("seq"))) < F.min(F.when(~older, F.col("seq"))), F.lit(True)).alias("in_order"),
    )


def _same_millisecond_evict(spark, sf_dir):
    """Messages of whole days at one millisecond, from several batches; those of one
    sensor are persisted, the others stay."""
    day = 24 * MS_PER_HOUR
    rows = tables.messages(spark, sf_dir).withColumn("ts_ms", F.col("ts_ms") - F.col("ts_ms") % day)
    hot = _Run(spark).arrive(tables.raw_json(rows)).ingest().store.messages()
    left = evict_persisted(hot, hot.filter("sensor_type = 1"))
    return upsert_last(left, [F.desc("seq")]).select("id", "ts_ms", "sensor_type", "value")


def _with_defects(spark, sf_dir) -> Store:
    raw = tables.raw_with_defects(tables.messages(spark, sf_dir))
    return _Run(spark).arrive(raw).ingest().store


def _messages(spark, sf_dir):
    stored = _with_defects(spark, sf_dir).messages()
    return stored.select("id", "ts_ms", "sensor_type", "value", "bucket", "event_date")


def _quarantine(spark, sf_dir):
    stored = _with_defects(spark, sf_dir).quarantine()
    return stored.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def _delivered_twice(spark, sf_dir) -> Store:
    """Every event arrives twice, in the same batch or in different ones."""
    raw = tables.raw_json(tables.messages(spark, sf_dir))
    return _Run(spark).arrive(raw.unionAll(raw)).ingest(unique_ids=True).store


def _unique_ids(spark, sf_dir):
    stored = _delivered_twice(spark, sf_dir).messages()
    return stored.select("id", "ts_ms", "sensor_type", "value", "bucket", "event_date")


def _turned_away(spark, sf_dir):
    rejected = _delivered_twice(spark, sf_dir).quarantine()
    return rejected.select(F.get_json_object("raw", "$.id").alias("id"), "reason")


def _trailing_hour(spark, sf_dir):
    """The answer written after the last batch."""
    raw = tables.raw_json(tables.messages(spark, sf_dir))
    run = _Run(spark).arrive(raw)
    answers = f"{run.folder}/trailing_hour"
    run.ingest(after_commit=trailing_hour_writer(run.store, answers))
    last = run.store.commits().agg(F.max("batch_id")).first()[0]
    return spark.read.parquet(f"{answers}/batch_id={last}")


def _backlog(spark, sf_dir):
    """Lines that have arrived and are not committed: before any batch, after a part was
    drained, sealed and cleaned up, and at the end."""
    rows = tables.raw_with_defects(tables.messages(spark, sf_dir))
    run = _Run(spark).arrive(rows)
    counts = [backlog_rows(run.store, run.log)]
    run.ingest()
    run.store.seal(LATE_BEFORE)
    run.store.remove_superseded(timedelta(0))
    run.arrive(rows)
    counts.append(backlog_rows(run.store, run.log))
    run.ingest()
    run.store.seal(LATE_BEFORE)
    counts.append(backlog_rows(run.store, run.log))
    return spark.createDataFrame(list(enumerate(counts)), "step INT, backlog BIGINT")


def _trailing_hour_state(spark, sf_dir):
    """The answer after the last batch, from the state that the batches hand on."""
    run = _Run(spark).arrive(tables.raw_json(tables.messages(spark, sf_dir)))
    sink = TrailingHour(spark, f"{run.folder}/hour")
    run.ingest(also=[sink])
    last = run.store.commits().agg(F.max("batch_id")).first()[0]
    return spark.read.parquet(f"{sink.folder}/answers/batch_id={last}")


# Rows of the hot table that make it move, and seconds without any.
HOT_ROWS, HOT_IDLE_S = 500, 1.0


def _hot_table(spark, sf_dir) -> tuple[_Run, HotTable]:
    """Two parts of the log: the first is moved by its size, the second, too small for that,
    by idleness."""
    rows = tables.messages(spark, sf_dir)
    run = _Run(spark)
    hot = HotTable(run.store, f"{run.folder}/hot", max_rows=HOT_ROWS, idle_s=HOT_IDLE_S)
    last = rows.orderBy(F.desc("seq")).limit(HOT_ROWS // 5).select("seq").withColumn("late", F.lit(True))
    parts = rows.join(F.broadcast(last), "seq", "left")
    run.arrive(tables.raw_json(parts.filter("late IS NULL")))
    hot.start(text_stream(spark, run.log), f"{run.folder}/checkpoint", AVAILABLE_NOW).awaitTermination()
    run.arrive(tables.raw_json(parts.filter("late")), files=2)
    query = hot.start(text_stream(spark, run.log), f"{run.folder}/checkpoint", {"processingTime": "1 second"})
    deadline = time.monotonic() + 120
    while "idle" not in hot.moves and time.monotonic() < deadline and query.isActive:
        time.sleep(0.2)
    hot.stop(query)
    return run, hot


def _hot_moved(spark, sf_dir):
    """The store after both moves; nothing is hot any more."""
    run, hot = _hot_table(spark, sf_dir)
    left = hot.messages().agg(F.count(F.lit(1)).alias("hot"))
    moved = run.store.messages().select(_STORED)
    reasons = F.array_join(F.array(*map(F.lit, sorted(set(hot.moves)))), ",")
    return moved.join(F.broadcast(left)).withColumn("moves", reasons)


def _table_stream(spark, folder, rows: DataFrame) -> DataFrame:
    """``rows`` as a stream of several files and so several micro-batches."""
    use_rocksdb_state(spark)
    path = f"{folder}/input"
    times = _times_more_files(rows.count(), 2 * FILES_PER_BATCH)
    rows.repartition(2 * FILES_PER_BATCH * times).write.parquet(path)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH * times)
    return reader.parquet(path)


def _windowed(spark, sf_dir):
    """Stateful one-second windows in update mode; the last update of a key holds."""
    folder = workspace(spark, "windows")
    rows = tables.events_as_messages(
        _table_stream(spark, folder, tables.table(spark, sf_dir, "events"))
    )

    def write(updates: DataFrame, batch_id: int) -> None:
        updates.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    windowed_rollup(rows).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(**AVAILABLE_NOW).start().awaitTermination()
    updates = spark.read.parquet(f"{folder}/rows")
    return upsert_last(updates, [F.desc("batch_id")], ["bucket", "sensor_type"]).drop("batch_id")


def _dedup(spark, sf_dir):
    """Ids that pass the stateful filter; which copy of one passes is up to arrival."""
    folder = workspace(spark, "unique")
    rows = tables.as_shipments(
        _table_stream(spark, folder, tables.table(spark, sf_dir, "lineitem"))
    )
    unique_stream(rows).select("id").writeStream.format("parquet").option(
        "path", f"{folder}/rows"
    ).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        **AVAILABLE_NOW
    ).start().awaitTermination()
    return spark.read.schema("id STRING").parquet(f"{folder}/rows")


_ROLLUP = f"WITH {MESSAGES_SQL} {rollup_sql('messages')}"

QUERIES = {
    "stream_rollup": Query(_rollup, _ROLLUP),
    "stream_late_rows": Query(_late_rows, _ROLLUP),
    "stream_two_checkpoints": Query(_two_checkpoints, _ROLLUP),
    "stream_restart": Query(_restarted, _ROLLUP),
    "stream_unique_ids_any_split": Query(
        _any_split,
        f"""WITH {MESSAGES_SQL}
        SELECT id, ts_ms, sensor_type, value, bucket, event_date FROM messages
        UNION ALL SELECT id, ts_ms, sensor_type, value, bucket, event_date FROM messages""",
    ),
    "stream_unlike_files": Query(
        _unlike_files,
        f"""WITH {MESSAGES_SQL}
        SELECT id, ts_ms, sensor_type, value, bucket, event_date, CAST(1 AS BIGINT) AS batches FROM messages""",
    ),
    "stream_arrival_order": Query(
        _arrival_order,
        "SELECT count(*) AS messages, count(*) AS numbers, TRUE AS in_order FROM events",
    ),
    "stream_same_millisecond_evict": Query(
        _same_millisecond_evict,
        f"""WITH {MESSAGES_SQL}
        SELECT id, ts_ms - ts_ms % {24 * MS_PER_HOUR} AS ts_ms, sensor_type, value
        FROM messages WHERE sensor_type <> 1""",
    ),
    "stream_windowed_rollup": Query(
        _windowed,
        f"""WITH {MESSAGES_SQL}
        SELECT bucket, sensor_type, min(value) AS min_value, max(value) AS max_value,
               CAST(sum(value) AS DECIMAL(38,0)) AS total, count(*) AS cnt
        FROM messages GROUP BY bucket, sensor_type""",
    ),
    "stream_messages": Query(
        _messages,
        f"""WITH {MESSAGES_SQL}
        SELECT id, ts_ms, sensor_type, value, ts_ms // 1000 AS bucket,
               CAST(epoch_ms(ts_ms) AS DATE) AS event_date
        FROM (SELECT id, sensor_type, value, seq,
                     CASE WHEN seq % 50 = 10 THEN ts_ms - 7200000 ELSE ts_ms END AS ts_ms
              FROM messages)
        WHERE seq % 50 NOT IN (1, 2, 3, 4, 5, 8)""",
    ),
    "stream_quarantine": Query(
        _quarantine,
        """SELECT CASE event_id % 50 WHEN 2 THEN 'missing_field' WHEN 3 THEN 'bad_timestamp'
               WHEN 4 THEN 'bad_number' WHEN 5 THEN 'bad_number' ELSE 'malformed_json' END
               AS reason, count(*) AS messages
        FROM events WHERE event_id % 50 IN (1, 2, 3, 4, 5, 8) GROUP BY ALL""",
    ),
    "stream_dedup": Query(_dedup, f"WITH {SHIPMENTS_SQL} SELECT DISTINCT id FROM shipments"),
    "stream_unique_ids": Query(
        _unique_ids,
        f"""WITH {MESSAGES_SQL}
        SELECT id, ts_ms, sensor_type, value, bucket, event_date FROM messages""",
    ),
    "stream_turned_away": Query(
        _turned_away,
        "SELECT CAST(event_id AS VARCHAR) AS id, 'duplicate_id' AS reason FROM events",
    ),
    "stream_backlog": Query(
        _backlog,
        """SELECT CAST(step AS INTEGER) AS step, CASE WHEN step < 2 THEN n ELSE 0 END AS backlog
        FROM (SELECT count(*) AS n FROM events), range(3) r(step)""",
    ),
    "stream_hot_moved": Query(
        _hot_moved,
        f"""WITH {MESSAGES_SQL}
        SELECT id, ts_ms, sensor_type, value, bucket, event_date, CAST(0 AS BIGINT) AS hot, 'idle,rows' AS moves
        FROM messages""",
    ),
    "stream_trailing_hour_state": Query(
        _trailing_hour_state,
        f"""WITH {MESSAGES_SQL} {synthesis_sql(
            f"messages WHERE ts_ms >= (SELECT max(ts_ms) FROM messages) - {MS_PER_HOUR}")}""",
    ),
    "stream_trailing_hour": Query(
        _trailing_hour,
        f"""WITH {MESSAGES_SQL} {synthesis_sql(
            f"messages WHERE ts_ms >= (SELECT max(ts_ms) FROM messages) - {MS_PER_HOUR}")}""",
    ),
}
