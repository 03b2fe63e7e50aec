"""Duplicate ids, id probes, upserts and eviction.

Keeping one row per key filters ``row_number() = 1``, which Spark also applies
before the shuffle: a key with a third of all rows sends one row per map task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.joins import probe
from pulsegrid.schema import MESSAGE_KEY


def first_per_key(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; ``order`` should be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def first_by_id(messages: DataFrame, order: list[str | Column] = MESSAGE_KEY) -> DataFrame:
    """First message of each id wins."""
    return first_per_key(messages, ["id"], order)


def repeated_ids(messages: DataFrame, order: list[str | Column] = MESSAGE_KEY) -> DataFrame:
    """Every message that ``first_by_id`` turns away, copies included.

    The bag difference is an aggregation over whole rows, so a hot id is spread
    over all partitions instead of being numbered in one.
    """
    return messages.exceptAll(first_by_id(messages, order))


def known_ids(probes: DataFrame, store: DataFrame, on: str = "id") -> DataFrame:
    """Rows of ``probes`` whose id is in ``store``."""
    return probe(probes, store, [on], "left_semi")


def new_ids(probes: DataFrame, store: DataFrame, on: str = "id") -> DataFrame:
    """Rows of ``probes`` whose id is not in ``store``."""
    return probe(probes, store, [on], "left_anti")


def upsert_last(rows: DataFrame, arrival: list[str | Column], keys: list[str] = MESSAGE_KEY) -> DataFrame:
    """One row per key, the last to arrive; ``arrival`` orders last first."""
    return first_per_key(rows, keys, arrival)


def evict_persisted(hot: DataFrame, persisted: DataFrame, keys: list[str] = MESSAGE_KEY) -> DataFrame:
    """Rows of ``hot`` that ``persisted`` does not hold yet."""
    return probe(hot, persisted, keys, "left_anti")
