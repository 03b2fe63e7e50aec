import pytest
from conftest import rows_of

from pulsegrid.operators import identity, joins


@pytest.fixture(scope="module")
def table(spark):
    def build(rows):
        return spark.createDataFrame(rows, "id STRING, ts_ms BIGINT, seq BIGINT, value BIGINT")

    return build


# "a" is a hot id; two of its rows are the same row twice.
ROWS = [("a", n % 5, n // 5, n) for n in range(40)] + [("a", 0, 0, 0), ("b", 9, 1, 1), ("c", 3, 2, 2)]


def test_first_wins_and_the_rest_is_complete(table):
    first = identity.first_by_id(table(ROWS))
    assert rows_of(first) == [("a", 0, 0, 0), ("b", 9, 1, 1), ("c", 3, 2, 2)]
    rest = rows_of(identity.repeated_ids(table(ROWS)))
    assert len(rest) == len(ROWS) - 3 and rest.count(("a", 0, 0, 0)) == 1


def test_hot_key_is_reduced_before_the_shuffle(table):
    plan = identity.first_by_id(table(ROWS))._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_exchange and "Partial" in before_exchange


@pytest.mark.parametrize("broadcast_rows, heavy_keys", [(1_000_000, 10_000), (0, 10_000), (0, 3)])
def test_probes(table, monkeypatch, broadcast_rows, heavy_keys):
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(joins, "MAX_HEAVY_KEYS", heavy_keys)
    store = table([("a", 1, 1, 1), ("a", 2, 2, 2), ("z", 1, 1, 1)])
    probes = table([("a", 7, 7, 7), ("q", 8, 8, 8), ("a", 9, 9, 9), (None, 1, 1, 1)])
    ids = lambda df: sorted(str(row["id"]) for row in df.collect())
    assert ids(identity.known_ids(probes, store)) == ["a", "a"]
    assert ids(identity.new_ids(probes, store)) == ["None", "q"]


def test_last_wins(table):
    rows = table([("x", 1, 1, 10), ("y", 1, 1, 20), ("z", 1, 2, 5)])
    from pyspark.sql import functions as F

    got = identity.upsert_last(rows, [F.desc("value")])
    assert rows_of(got.select("ts_ms", "seq", "value")) == [(1, 1, 20), (1, 2, 5)]


def test_eviction(table):
    hot = table([("a", 1, 1, 1), ("b", 1, 2, 2), ("c", 2, 1, 3)])
    persisted = table([("b", 1, 2, 2), ("d", 9, 9, 9)])
    assert rows_of(identity.evict_persisted(hot, persisted).select("id")) == [("a",), ("c",)]
