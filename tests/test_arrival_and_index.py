"""Order of arrival, the index of ids, rollup levels, hot table, handed-on trailing hour."""

import json
import random
import time
from datetime import date, timedelta

import expected
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pulsegrid.functions import exact
from pulsegrid.operators.hybrid import BLOCK_SECONDS, fewest_blocks
from pulsegrid.operators.synthesis import finish, partials, spread_partials
from pulsegrid.session import workspace
from pulsegrid.storage.store import Store
from pulsegrid.streaming.hot import HotTable
from pulsegrid.streaming.ingest import backlog_rows, flush, load_batch, text_stream
from pulsegrid.streaming.live import TrailingHour, unique_stream, use_rocksdb_state

B = 1_463_738_400_000
HOUR = 3_600_000


def line(i, ts, sensor, value):
    return json.dumps({"id": i, "timestamp": ts, "sensorType": sensor, "value": value})


def write_lines(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.mode("append").text(folder)
    time.sleep(0.05)  # files of unlike age


@pytest.fixture
def root(spark):
    return workspace(spark, "test-arrival")


@pytest.mark.parametrize("max_files", [None, 1])
def test_older_file_wins_whatever_the_sizes(spark, root, max_files):
    log = f"{root}/log-{max_files}"
    write_lines(spark, log, [line("x", B, 1, 1)])
    write_lines(spark, log, [line("x", B, 1, 2), *(line(f"y{i}", B, 1, i) + " " * 3000 for i in range(500))])
    write_lines(spark, log, [line("y7", B - HOUR, 1, -1), line("z", B, 1, 3)])
    store = Store(spark, f"{root}/store-{max_files}", "s")
    flush(store, text_stream(spark, log, max_files), f"{root}/checkpoint-{max_files}", timestamp="any", unique_ids=True)
    assert store.commits().count() == (1 if max_files is None else 3)
    found = {r["id"]: r["value"] for r in store.messages().collect()}
    assert len(found) == 502 and (found["x"], found["y7"], found["z"]) == (1, 7, 3)
    assert store.quarantine().count() == 2
    seq = {r["id"]: r["seq"] for r in store.messages().collect()}
    assert seq["x"] < seq["y0"] < seq["y1"] < seq["y499"] < seq["z"] and len(set(seq.values())) == 502


def test_rows_without_origin_arrive_by_split(spark, root):
    store = Store(spark, f"{root}/store")
    raw = spark.createDataFrame([(line("a", B, 1, 1),), (line("a", B, 1, 2),), ("bad",)], "raw STRING").coalesce(1)
    load_batch(store, raw, 7, unique_ids=True, timestamp="any")
    assert [(r["id"], r["value"], r["seq"]) for r in store.messages().collect()] == [("a", 1, 7 << 36)]
    with pytest.raises(ValueError):
        load_batch(store, raw, 1 << 27)


def scanned(df):
    return sorted({part for path in df.inputFiles() for part in ("/messages/", "/sealed_messages/", "/ids/", "/sealed_ids/") if part in path})


def test_probe_reads_matching_buckets(spark, root):
    store = Store(spark, f"{root}/store", "s")
    lines = [(line(f"id{i}", B + i * 3_600_000, i % 3, i),) for i in range(400)]
    load_batch(store, spark.createDataFrame(lines[:300], "raw STRING"), 0, timestamp="any")
    store.seal(date(2016, 5, 28))
    load_batch(store, spark.createDataFrame(lines[300:], "raw STRING"), 1, timestamp="any")
    probes = spark.createDataFrame([("id3",), ("id3",), ("id399",), ("no",), (None,)], "id STRING")
    ids = store.ids()
    narrow = ids.matching(probes)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "In(id_bucket" in plan and "In(id, [" in plan
    assert scanned(narrow) == ["/ids/", "/sealed_ids/"]
    assert rows_of(ids.known(probes)) == [("id3",), ("id3",), ("id399",)]
    assert sorted(map(str, (r["id"] for r in ids.unknown(probes).collect()))) == ["None", "no"]
    many = spark.createDataFrame([(f"id{i}",) for i in range(200, 600)], "id STRING")
    assert ids.known(many).count() == 200 and ids.unknown(many).count() == 200
    empty = Store(spark, f"{root}/empty").ids()
    assert empty.known(probes).count() == 0 and empty.unknown(probes).count() == 5
    # ids of dropped days are forgotten with their messages
    store.seal(date(2016, 5, 28), keep_from=date(2016, 5, 22))
    assert {r["id"] for r in store.ids().unknown(probes).collect()} == {"id3", "no", None}


def test_sums_beyond_the_bound_of_limbs(spark, messages_of, monkeypatch):
    monkeypatch.setattr(exact, "MAX_ROWS_PER_GROUP", 60)
    big = 9_223_372_036_854_775_807
    rows = [(B + i, i % 2, (big, -big - 1, 7)[i % 3]) for i in range(600)]
    messages = messages_of(rows).repartition(16, "seq")
    with pytest.raises(Exception, match="rows in one group"):
        partials(messages, "sensor_type").collect()
    got = finish(spread_partials(messages, "sensor_type"), "sensor_type")
    assert rows_of(got) == expected.synthesis(rows, B, B + 1000)


def test_fewest_blocks_cover_each_second_once():
    rng = random.Random(4)
    for _ in range(300):
        start = rng.randrange(0, 400_000_000)
        end = start + rng.choice([0, 900, 5_000, 200_000, 9_000_000, 300_000_000, 900_000_000]) + rng.randrange(1000)
        blocks = fewest_blocks(start, end)
        covered, count = [], 0
        for size, ranges in blocks.items():
            for a, b in ranges:
                assert a < b and a % size == 0 and b % size == 0
                covered.append((a, b))
                coarser = next((x for x in BLOCK_SECONDS if x > size), None)
                assert coarser is None or (b - a) // size < 2 * coarser // size
                count += 1
        covered.sort()
        lo, hi = start // 1000 + 1, end // 1000
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
        assert not covered and lo >= hi or (covered[0][0], covered[-1][1]) == (lo, hi)
        assert count <= 7


def test_levels_answer_as_raw_rows(spark, root, messages_of):
    rng = random.Random(9)
    rows = [(B + rng.randrange(0, 4 * 86_400_000), rng.randrange(4), rng.randrange(-50, 50)) for _ in range(3000)]
    store = Store(spark, f"{root}/store", "s")
    store.append(messages_of(rows[:2000]).cache(), 0)
    store.seal(date(2016, 5, 23))
    store.append(messages_of(rows[2000:]).cache(), 1)
    for k in range(2):
        now = store.snapshot()
        for start, end in [(B, B + 4 * 86_400_000), (B + 1, B + 7_300_500), (B + 86_400_000 - 1, B + 3 * 86_400_000), (B + 5, B + 9)]:
            assert rows_of(now.synthesis(start, end)) == expected.synthesis(rows, start, end)
        store.seal(date(2016, 5, 23) + timedelta(days=k))
    hours = store.of_gen("sealed_rollup_3600s", store.newest_seal().gen)
    assert hours.filter("bucket % 3600 <> 0").count() == 0 and 0 < hours.count() < 4 * 4 * 25


def test_state_has_one_entry_an_id(spark, root):
    use_rocksdb_state(spark)
    rows = [(("hot", f"i{i % 40}", None)[i % 3], i) for i in range(3000)]
    spark.createDataFrame(rows, "id STRING, n INT").repartition(6).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("id STRING, n INT").option("maxFilesPerTrigger", 3).parquet(f"{root}/in")
    query = (
        unique_stream(stream).writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    different = len({i for i, _ in rows})
    assert spark.read.parquet(f"{root}/out").count() == different
    [state] = query.lastProgress["stateOperators"]
    assert state["numRowsTotal"] == different


def test_trailing_hour_from_state(spark, root, messages_of):
    clock = [B + 10 * HOUR]
    sink = TrailingHour(spark, f"{root}/hour", clock_ms=lambda: clock[0])
    batches = [
        [(B, 1, 5), (B + 30, 2, 7)],
        [(B + HOUR, 1, 9), (253_402_300_000_000, 1, 1)],
        [],
        [(B + HOUR + 29, 1, 11)],
        [(B + 3 * HOUR, 3, 1), (B + HOUR, 1, 1000)],
    ]
    seen = []
    for n, rows in enumerate(batches):
        for _ in range(2):  # a repeated batch starts from the same state
            sink(messages_of(rows), n)
        seen += rows
        end = min(max(ts for ts, *_ in seen), clock[0])
        answer = spark.read.parquet(f"{root}/hour/answers/batch_id={n}")
        assert rows_of(answer) == expected.synthesis(seen, end - HOUR, end)


def test_hot_table(spark, root):
    now = [0.0]
    store = Store(spark, f"{root}/store", "hot")
    hot = HotTable(store, f"{root}/hot", max_rows=5, idle_s=10, clock=lambda: now[0])
    raw = lambda a, b: spark.createDataFrame([(line(f"i{i}", B + i, 1, i),) for i in range(a, b)] + [("bad",)], "raw STRING")
    rows = [(B + i, 1, i) for i in range(12)]

    def check(upto):
        assert rows_of(hot.synthesis(B, B + 100)) == expected.synthesis(rows[:upto], B, B + 100)

    hot.load(raw(0, 3), 0, timestamp="any")
    hot.load(raw(0, 3), 0, timestamp="any")
    check(3)
    assert store.messages().count() == 0 and not hot.tick()
    hot.load(raw(3, 6), 1, timestamp="any")
    assert hot.moves == ["rows"] and hot.messages().count() == 0 and store.messages().count() == 6
    check(6)
    hot.load(raw(3, 6), 1, timestamp="any")  # repeated after its move
    hot.load(raw(6, 8), 2, timestamp="any")
    now[0] = 9.0
    assert not hot.tick()
    check(8)
    now[0] = 11.0
    assert hot.tick() and hot.moves == ["rows", "idle"] and hot.messages().count() == 0
    now[0] = 30.0
    assert not hot.tick()
    check(8)
    assert store.quarantine().count() == 3
    # another object on the same folders goes on where this one stopped
    again = HotTable(store, f"{root}/hot", max_rows=5, idle_s=10)
    again.load(raw(8, 12), 3, timestamp="any")
    assert again.messages().count() == 4
    again.move("by hand")
    assert rows_of(store.synthesis(B, B + 100)) == expected.synthesis(rows, B, B + 100)


def test_backlog_counts_sealed_and_removed_batches_once(spark, root):
    log, store = f"{root}/log", Store(spark, f"{root}/store", "s")
    assert backlog_rows(store, log) == 0
    for k in range(3):
        write_lines(spark, log, [line(f"{k}-{i}", B + i, 1, i) for i in range(10)] + ["bad", ""])
        assert backlog_rows(store, log) == 12
        flush(store, text_stream(spark, log, 1), f"{root}/checkpoint", timestamp="any")
        store.seal(date(2016, 5, 21))
        if k == 1:
            store.remove_superseded(timedelta(0))
        assert backlog_rows(store, log) == 0
    assert store.arrived() == 36
