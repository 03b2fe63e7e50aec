"""Every registered query against its SQL, on the smallest tables."""

import check_oracles
import pytest

import __spark_entry__ as entry_module
from pulsegrid.plans import batch, stored, streams


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["sensor_type", "min_value", "max_value", "medium_value", "count"]
    assert result.count() == 10


def test_every_query_on_messages_has_sql():
    named = {**batch.QUERIES, **stored.QUERIES, **streams.QUERIES}
    assert set(named) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


# The rest of the stored and streaming queries is covered by test_store and
# test_streaming; check_oracles.py runs all of them.
NAMES = [
    *batch.QUERIES,
    "store_synthesis_requests",
    "store_sensor_layout",
    "stream_late_rows",
    "stream_windowed_rollup",
    "stream_dedup",
    "store_removed",
    "store_out_of_order_batches",
    "store_retention_late_rows",
    "stream_two_checkpoints",
    "stream_restart",
    "stream_unique_ids_any_split",
    "stream_same_millisecond_evict",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, name):
    equal, note = check_oracles.compare(spark, sf_dir, name)
    assert equal, note
