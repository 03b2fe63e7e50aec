import glob
import json

import expected
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pulsegrid.plans import streams
from pulsegrid.session import workspace
from pulsegrid.sources.messages import DUPLICATE_ID
from pulsegrid.storage.store import Store
from pulsegrid.streaming import ingest
from pulsegrid.streaming.ingest import flush, load_batch, start_ingest, text_stream
from pulsegrid.streaming.live import trailing_hour_writer, unique_stream, use_rocksdb_state

B = 1_463_738_400_000


def _lines(spark, rows):
    texts = [
        json.dumps({"id": str(i), "timestamp": ts, "sensorType": s, "value": v})
        for i, ts, s, v in rows
    ]
    return spark.createDataFrame([(text,) for text in texts], "value STRING").coalesce(1)


def _rows(start, count):
    return [(start + n, B + (start + n) * 431, n % 2, n) for n in range(count)]


class Feed:
    def __init__(self, spark):
        self.spark = spark
        self.root = workspace(spark, "test-feed")
        self.store = Store(spark, f"{self.root}/store", "feed")

    def arrive(self, rows):
        _lines(self.spark, rows).write.mode("append").text(f"{self.root}/log")

    def stream(self, max_files=1):
        return text_stream(self.spark, f"{self.root}/log", max_files)

    def ingest(self, **options):
        options.setdefault("timestamp", "any")
        flush(self.store, self.stream(), f"{self.root}/checkpoint", **options)

    def check(self, rows):
        plain = [(ts, s, v) for _, ts, s, v in rows]
        want = expected.synthesis(plain, B, B + 10**9)
        assert rows_of(self.store.synthesis(B, B + 10**9)) == want


@pytest.fixture
def feed(spark):
    return Feed(spark)


def test_restart_continues_where_it_stopped(feed):
    first, second = _rows(0, 20), _rows(100, 30)
    feed.arrive(first)
    feed.ingest()
    feed.check(first)
    feed.ingest()  # nothing new
    feed.check(first)
    feed.arrive(second)
    feed.ingest()
    feed.check(first + second)


def test_crash_before_commit_is_repaired_by_the_retry(feed):
    rows = _rows(0, 25)
    feed.arrive(rows)

    def fail(df, batch_id):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        feed.ingest(also=[fail])
    assert feed.store.messages().count() == 0
    feed.ingest()
    feed.check(rows)


def test_crash_after_commit_does_not_repeat_the_batch(feed):
    rows = _rows(0, 25)
    feed.arrive(rows)

    def fail(batch_id):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        feed.ingest(after_commit=fail)
    feed.check(rows)
    done = []
    feed.ingest(after_commit=done.append)
    feed.check(rows)
    assert done == [0]


def test_late_rows_reach_sealed_buckets(feed):
    from datetime import date

    rows = _rows(0, 20)
    feed.arrive(rows)
    feed.ingest()
    feed.store.seal(date(2016, 6, 1))
    late = [(900 + n, ts + 1, s, v + 7) for n, (_, ts, s, v) in enumerate(rows)]
    feed.arrive(late)
    feed.ingest()
    feed.check(rows + late)


def test_unique_ids_within_and_across_batches(spark, feed):
    first = [("a", B, 1, 1), ("b", B, 1, 2), ("a", B + 5, 1, 3)]
    second = [("b", B - 5, 1, 4), ("c", B, 1, 5), ("c", B - 1, 1, 6)]
    for batch_id, rows in enumerate((first, second)):
        raw = _lines(spark, rows).toDF("raw")
        load_batch(feed.store, raw, batch_id, unique_ids=True, timestamp="any")
    kept = feed.store.messages().select("id", "value")
    assert rows_of(kept) == [("a", 1), ("b", 2), ("c", 5)]
    rejected = feed.store.quarantine()
    assert {row["reason"] for row in rejected.collect()} == {DUPLICATE_ID}
    values = rejected.select(F.get_json_object("raw", "$.value").cast("int"))
    assert rows_of(values) == [(3,), (4,), (6,)]
    assert feed.store.count().first()[0] == 3


def test_trailing_hour_after_each_batch(spark, feed):
    hour = 3_600_000
    batches = [[(1, B, 1, 10), (2, B - hour - 1, 1, 99)], [(3, B + hour, 1, 20), (4, B + 5, 2, 30)]]
    out = f"{feed.root}/trailing"
    for rows in batches:
        feed.arrive(rows)
        feed.ingest(after_commit=trailing_hour_writer(feed.store, out))
    so_far = []
    for batch_id, rows in enumerate(batches):
        so_far += [(ts, s, v) for _, ts, s, v in rows]
        newest = max(ts for ts, _, _ in so_far)
        got = spark.read.parquet(f"{out}/batch_id={batch_id}")
        assert rows_of(got) == expected.synthesis(so_far, newest - hour, newest)


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_stateful_dedup(spark, feed, delay):
    use_rocksdb_state(spark)
    feed.arrive([("a", B, 1, 1), ("b", B, 1, 1), ("a", B + 1, 1, 2)])
    feed.arrive([("a", B + 2, 1, 3), ("c", B, 1, 1)])
    from pulsegrid.sources.messages import accepted, read_messages

    messages = accepted(read_messages(feed.stream(), timestamp="any"))
    query = (
        unique_stream(messages, delay)
        .select("id")
        .writeStream.format("parquet")
        .option("path", f"{feed.root}/unique")
        .option("checkpointLocation", f"{feed.root}/unique-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    ids = spark.read.schema("id STRING").parquet(f"{feed.root}/unique")
    assert rows_of(ids) == [("a",), ("b",), ("c",)]


def test_continuous_trigger_and_backlog(spark, feed):
    from pulsegrid.streaming.ingest import EVERY_5_SECONDS, backlog_rows

    rows = _rows(0, 10)
    checkpoint = f"{feed.root}/checkpoint"
    feed.arrive(rows)
    assert backlog_rows(feed.store, f"{feed.root}/log") == 10
    query = start_ingest(
        feed.store, feed.stream(), checkpoint, trigger=EVERY_5_SECONDS, timestamp="any"
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert backlog_rows(feed.store, f"{feed.root}/log") == 0
    feed.arrive(_rows(50, 7))
    assert backlog_rows(feed.store, f"{feed.root}/log") == 7
    feed.check(rows)


def test_a_second_checkpoint_needs_its_own_stream(spark, feed):
    from pyspark.errors import StreamingQueryException

    first, second = _rows(0, 10), _rows(100, 10)
    feed.arrive(first)
    feed.ingest()
    feed.arrive(second)
    with pytest.raises(StreamingQueryException, match="was committed by"):
        flush(feed.store, feed.stream(), f"{feed.root}/other", timestamp="any")
    with pytest.raises(ValueError, match="stream_id"):
        flush(Store(spark, feed.store.root), feed.stream(), f"{feed.root}/third", timestamp="any")
    flush(feed.store, feed.stream(), f"{feed.root}/checkpoint", timestamp="any")
    feed.check(first + second)


def test_seq_is_unique_across_batches(feed):
    rows = [(n, B, 1, n) for n in range(6)]
    for row in rows:
        feed.arrive([row])
    feed.ingest()
    assert feed.store.messages().select("seq").distinct().count() == 6


def test_late_new_id_passes_the_stateful_dedup(spark, feed):
    from pulsegrid.sources.messages import accepted, read_messages

    use_rocksdb_state(spark)
    feed.arrive([("a", B, 1, 1)])
    feed.arrive([("old", B - 19 * 3_600_000, 1, 1), ("a", B, 1, 2)])
    messages = accepted(read_messages(feed.stream(), timestamp="any"))
    query = (
        unique_stream(messages, "1 hour").select("id").writeStream.format("parquet")
        .option("path", f"{feed.root}/late").option("checkpointLocation", f"{feed.root}/late-checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows_of(spark.read.schema("id STRING").parquet(f"{feed.root}/late")) == [("a",), ("old",)]


def _parts(folder):
    return len(glob.glob(f"{folder}/part-*"))


def test_large_tables_arrive_in_more_files_and_as_many_batches(spark, monkeypatch):
    """A task writes a file, so its share must not grow with the table."""
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 50)
    rows = spark.range(3_000).selectExpr("id", "cast(id AS STRING) AS raw")
    folder = workspace(spark, "many-files")
    streams._table_stream(spark, folder, rows)
    assert _parts(f"{folder}/input") == 60
    run = streams._Run(spark).arrive(rows.select("raw"), files=6, rows=3_000, padding=5)
    assert _parts(run.log) == 60 and run.times * streams.FILES_PER_BATCH == 30
    assert spark.read.text(run.log).filter("value LIKE '%     '").count() == 3_000
    monkeypatch.undo()
    assert streams._Run(spark).arrive(rows.select("raw"), files=6, rows=3_000).times == 1


def test_text_of_good_rows_is_not_kept(spark, monkeypatch):
    held = []
    numbered = ingest.numbered
    monkeypatch.setattr(ingest, "numbered", lambda read, batch_id: held.append(read) or numbered(read, batch_id))
    good = '{"id":"a","timestamp":"2016-05-20T10:00:00Z","sensorType":1,"value":2}' + " " * 500
    raw = spark.createDataFrame([(good,), ("rubbish",)], "raw STRING")
    store = Store(spark, workspace(spark, "store"), stream_id="text")
    assert ingest.load_batch(store, raw, 0)
    assert [r.raw for r in held[0].collect() if r.raw is not None] == ["rubbish"]
    assert [r.raw for r in store.quarantine().collect()] == ["rubbish"] and store.messages().count() == 1


def _events(spark, count):
    folder = workspace(spark, "few-events")
    spark.range(count).selectExpr(
        "id AS event_id",
        "cast(timestamp_millis(1704067200000 + id * 40009) AS TIMESTAMP_NTZ) AS ts",
        "id % 7 AS user_id",
        "'view' AS event_type",
        "id / 4 AS value",
        "'{}' AS props",
    ).write.parquet(f"{folder}/events.parquet")
    return folder


def test_blanks_of_unlike_files_take_little_disk(spark, monkeypatch):
    """Every line keeps its blanks, and newer files stay many times the size of older ones."""
    runs, rows = [], 4_000

    class Run(streams._Run):
        def __init__(self, *args):
            super().__init__(*args)
            runs.append(self)

    monkeypatch.setattr(streams, "_Run", Run)
    stored = streams._unlike_files(spark, _events(spark, rows))
    assert stored.count() == stored.select("id").distinct().count() == rows
    assert stored.filter("batches = 1 AND ts_ms >= 1704067200000").count() == rows
    [run] = runs
    lines = spark.read.text(run.log).selectExpr(
        "length(value) - length(rtrim(value)) AS blanks", "length(value) AS long", "_metadata.file_path AS path", "_metadata.file_size AS size"
    )
    assert rows_of(lines.groupBy("blanks").count()) == [(0, rows), (2_000, rows)]
    files = lines.groupBy("path", "size").agg(F.max("blanks").alias("blanks"), F.sum("long").alias("long")).collect()
    assert sum(f.size for f in files) < sum(f.long for f in files) / 20
    older, newer = ([f.size for f in files if (f.blanks > 0) == padded] for padded in (False, True))
    assert (len(older), len(newer)) == (16, 2) and min(newer) > 5 * max(older)


def test_first_arrivals_are_kept_while_they_are_looked_up(spark, feed, monkeypatch):
    """A look-up reads its probes several times; nothing stays cached after the batch."""
    from pulsegrid.storage.ids import Ids

    probed, unknown = [], Ids.unknown
    monkeypatch.setattr(Ids, "unknown", lambda ids, probes: probed.append((probes, probes.is_cached)) or unknown(ids, probes))
    for batch_id, rows in enumerate(([("a", B, 1, 1), ("a", B, 1, 2)], [("a", B, 1, 3), ("b", B, 1, 4), ("c", B, 1, 5)])):
        raw = _lines(spark, rows).toDF("raw")
        load_batch(feed.store, raw, batch_id, unique_ids=True, timestamp="any")
    assert [kept for _, kept in probed] == [True, True]
    assert not any(rows.storageLevel.useMemory or rows.storageLevel.useDisk for rows, _ in probed)
    assert rows_of(feed.store.messages().select("id", "value")) == [("a", 1), ("b", 4), ("c", 5)]
    assert feed.store.quarantine().count() == 2 and feed.store.count().first()[0] == 3


def test_quarantine_is_worked_out_once(spark, feed, messages_of):
    seen = spark.sparkContext.accumulator(0)

    def bad(raw):
        seen.add(1)
        return True

    rejected = spark.createDataFrame([(f"bad {n}", "malformed_json") for n in range(5)], "raw STRING, reason STRING")
    rejected = rejected.filter(F.udf(bad, "boolean")("raw")).withColumn("ingest_ts", F.current_timestamp())
    feed.store.append(messages_of([(B, 1, 2)]), 0, quarantine=rejected)
    assert seen.value == 5 and feed.store.quarantine().count() == 5
    assert feed.store.commits().first()["quarantined"] == 5
    feed.store.append(messages_of([(B, 1, 3)]), 1, quarantine=rejected.limit(0))
    assert sorted(r["quarantined"] for r in feed.store.commits().collect()) == [0, 5]
