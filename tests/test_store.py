import shutil
from datetime import date

import expected
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pulsegrid.session import workspace
from pulsegrid.storage import store as store_module
from pulsegrid.storage.layout import overwrite
from pulsegrid.storage.store import Store

DAY = 86_400_000
B = 19_700 * DAY  # 2023-12-09
DAYS = [date(2023, 12, 9 + n) for n in range(4)]


def _rows(start, count):
    return [(B + (start + n) * 7_654_321 % (4 * DAY), n % 3, start + n) for n in range(count)]


@pytest.fixture
def store(spark):
    return Store(spark, workspace(spark, "test-store"))


def _check(store, rows, lo=B + 12_345, hi=B + 3 * DAY + 54_321):
    assert store.messages().count() == len(rows)
    assert store.count().first()[0] == len(rows)
    assert rows_of(store.synthesis(lo, hi)) == expected.synthesis(rows, lo, hi)


def test_empty(store):
    assert store.messages().count() == 0 and store.rollup().count() == 0
    assert store.count().first()[0] == 0 and store.latest_ms() is None
    assert rows_of(store.trailing_hour()) == []


def test_batches_commit_once(store, messages_of):
    rows, other = _rows(0, 60), _rows(1000, 60)
    assert store.append(messages_of(rows), 0)
    assert not store.append(messages_of(other), 0)
    _check(store, rows)
    assert store.append(messages_of(other), 1)
    _check(store, rows + other)


def test_unfinished_batch_is_invisible_and_replaced(store, messages_of):
    rows = _rows(0, 40)
    store.append(messages_of(rows), 0)
    # A crash after writing messages but before the commit row.
    lost = messages_of(_rows(500, 90))
    overwrite(lost, store.root, "messages", "stream_id=main/batch_id=1", by_day=True)
    _check(store, rows)
    retried = _rows(700, 20)
    store.append(messages_of(retried), 1)
    _check(store, rows + retried)


def test_empty_batch(store, messages_of):
    rows = _rows(0, 10)
    store.append(messages_of(rows).filter("false"), 0)
    store.append(messages_of(rows), 1)
    store.seal(DAYS[3])
    _check(store, rows)


@pytest.mark.parametrize("literal_streams", [store_module.MAX_LITERAL_RANGES, 0])
def test_sealing_keeps_every_row(store, spark, messages_of, monkeypatch, literal_streams):
    monkeypatch.setattr(store_module, "MAX_LITERAL_RANGES", literal_streams)
    rows = _rows(0, 80)
    store.append(messages_of(rows), 0)
    assert store.superseded().count() == 0
    assert store.seal(DAYS[2]) == 1
    # Late rows for sealed days, from this stream and from one the seal never saw.
    late, foreign = _rows(2000, 50), _rows(3000, 30)
    store.append(messages_of(late), 1)
    Store(spark, store.root, "other").append(messages_of(foreign), 0)
    everything = rows + late + foreign
    _check(store, everything)
    # An earlier horizon does not reopen days.
    assert store.seal(DAYS[1]) == 2
    assert store.messages().count() == len(everything)
    assert store.seal(date(2024, 1, 1)) == 3
    _check(store, everything)
    assert store.superseded().count() == 3
    assert store.rollup().count() == len({(ts // 1000, sensor) for ts, sensor, _ in everything})


def test_seal_rewrites_only_days_with_new_rows(store, messages_of):
    store.append(messages_of([(B + 5, 1, 1), (B + DAY, 1, 2)]), 0)
    store.seal(DAYS[3])
    store.append(messages_of([(B + DAY + 9, 1, 3)]), 1)
    store.seal(DAYS[3])
    days = store.of_gen("seal_days", 2).select("event_date", "data_gen", "day_rows")
    assert rows_of(days) == [(DAYS[0], 1, 1), (DAYS[1], 2, 2)]


def test_batch_of_many_days_writes_few_files(store, spark, messages_of):
    rows = messages_of([(B + n * DAY, 1, n) for n in range(50)]).repartition(8)
    store.append(rows, 0)
    files = spark.read.parquet(f"{store.root}/messages").select(F.input_file_name()).distinct()
    assert files.count() == 50


def test_stored_bounds_reach_the_scan(store, messages_of):
    store.append(messages_of(_rows(0, 40)), 0)
    plan = store.messages(B, B + DAY)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "event_date" in scan[: scan.index("PushedFilters")]
    assert "GreaterThanOrEqual(ts_ms" in plan


def test_fan_out_gets_what_the_store_gets(store, messages_of):
    seen = []
    rows = _rows(0, 15)
    store.append(messages_of(rows), 0, also=[lambda df, batch: seen.append((batch, df.count()))])
    store.append(messages_of(rows), 0, also=[lambda df, batch: seen.append((batch, df.count()))])
    assert seen == [(0, 15)]


def test_superseded_folders_are_not_needed(store, spark, messages_of, tmp_path):
    rows, late = _rows(0, 60), [(B + 3 * DAY + n, 1, n) for n in range(5)]
    store.append(messages_of(rows), 0)
    store.append(messages_of(late), 1)
    store.seal(DAYS[3])
    store.append(messages_of(_rows(400, 20)), 2)
    # Batch 0 reaches into the unsealed last day; once that is sealed as well, both go.
    assert store.superseded().count() == 0
    store.seal(date(2024, 1, 1))
    gone = {f"batch_id={row['batch_id']}" for row in store.superseded().collect()}
    assert gone == {"batch_id=0", "batch_id=1", "batch_id=2"}
    trimmed = tmp_path / "trimmed"
    shutil.copytree(store.root, trimmed, ignore=lambda _, names: gone & set(names))
    left = Store(spark, str(trimmed))
    _check(left, rows + late + _rows(400, 20))
    assert left.latest_ms() == store.latest_ms()
    assert not left.append(messages_of(rows), 1)


def test_retention_drops_whole_days(store, messages_of):
    rows = [(B + day * DAY + n, 1, n) for day in range(4) for n in range(3)]
    store.append(messages_of(rows), 0)
    store.seal(DAYS[2])
    store.append(messages_of([(B + 9, 1, 99)]), 1)
    store.seal(DAYS[2], keep_from=DAYS[1])
    kept = [row for row in rows if row[0] >= B + DAY]
    _check(store, kept, B, B + 9 * DAY)
    with pytest.raises(ValueError):
        store.seal(DAYS[2], keep_from=DAYS[3])


def test_removal_bounds_the_folders(spark, store, messages_of):
    from datetime import timedelta
    from pathlib import Path

    day = 86_400_000
    rows = []
    for n in range(6):
        new = [(n * day + k, 1, k) for k in range(5)]
        rows += new
        store.append(messages_of(new), n, quarantine=_rejected(spark, n))
        store.seal(date(1970, 1, 1) + timedelta(days=n + 1))
    assert store.remove_superseded(timedelta(hours=1)) == 0
    assert store.remove_superseded(timedelta(0)) > 0
    root = Path(store.root.removeprefix("file:"))
    assert not list(root.glob("messages/*/batch_id=*")) and not list(root.glob("commits/*/batch_id=*"))
    assert len(list(root.glob("seals/gen=*"))) == 1
    assert len(list(root.glob("sealed_messages/gen=*/event_date=*"))) == 6
    assert store.messages().count() == store.count().first()[0] == len(rows)
    assert store.quarantine().count() == 6
    assert not store.append(messages_of(rows[:5]), 0)
    assert store.remove_superseded(timedelta(0)) == 0


def _rejected(spark, n):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.lit(f"bad {n}").alias("raw"), F.lit("malformed_json").alias("reason"), F.current_timestamp().alias("ingest_ts"))
