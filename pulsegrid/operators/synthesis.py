"""Per-sensor minimum, maximum, exact average and count, and their partials.

A *partial* holds ``min_value, max_value, total, cnt``. Partials of disjoint
row sets merge to the partial of their union, so every route to an answer
(raw scan, rollup, hot and cold store, micro-batches) ends in ``merge_partials``
and ``finish``. All aggregates combine map-side: a sensor or second with a third
of all rows reaches the shuffle as one row per task.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.exact import exact_average, exact_sum, exact_sum_sql, rounded_average
from pulsegrid.functions.timeaxis import MS_PER_DAY, MS_PER_SECOND
from pulsegrid.operators.filters import complete_rows, within, within_half_open
from pulsegrid.schema import PARTIAL_VALUES

# Sensors a padded answer always lists, and the count it gives an absent one.
PADDED_SENSORS = range(1, 11)
PADDED_COUNT = 1


def partials(messages: DataFrame, *keys: str) -> DataFrame:
    """One partial per ``keys``."""
    return messages.groupBy(*keys).agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        exact_sum("value").alias("total"),
        F.count("value").alias("cnt"),
    )


def spread_partials(messages: DataFrame, *keys: str) -> DataFrame:
    """As ``partials``, for few keys with any number of rows.

    Limbs are put together once per key and input partition, and those totals are added as
    decimals, so the bound on exact limb sums holds for what one task reads of a key.
    """
    parts = partials(messages.withColumn("_part", F.spark_partition_id()), *keys, "_part")
    return merge_partials(parts, *keys)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, others, first)


def merge_partials(parts: DataFrame, *keys: str) -> DataFrame:
    """Merge the partials that share ``keys``."""
    return parts.groupBy(*keys).agg(
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("total").cast("decimal(38,0)").alias("total"),
        F.sum("cnt").alias("cnt"),
    )


def finish(parts: DataFrame, *keys: str) -> DataFrame:
    """Partials to answer rows: the average replaces the total."""
    return parts.select(
        *keys,
        "min_value",
        "max_value",
        exact_average("total", "cnt").alias("medium_value"),
        F.col("cnt").alias("count"),
    )


def synthesis_of(parts: DataFrame) -> DataFrame:
    """Merged, finished and ordered answer of any partials keyed by sensor."""
    return finish(merge_partials(parts, "sensor_type"), "sensor_type").orderBy("sensor_type")


def synthesis(messages: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Answer over ``[from_ms, to_ms]`` from raw messages alone."""
    rows = within(messages, from_ms, to_ms)
    return finish(spread_partials(rows, "sensor_type"), "sensor_type").orderBy("sensor_type")


def guarded_synthesis(messages: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """As ``synthesis``, for tables whose sensor or value may be missing."""
    return synthesis(complete_rows(messages), from_ms, to_ms)


def rounded_synthesis(messages: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Answer over ``[from_ms, to_ms)`` with a whole-number average and no count."""
    rows = within_half_open(messages, from_ms, to_ms)
    return (
        spread_partials(rows, "sensor_type")
        .select(
            "sensor_type",
            "min_value",
            "max_value",
            rounded_average("total", "cnt").alias("medium_value"),
        )
        .orderBy("sensor_type")
    )


def sql_summary(messages: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Count, total, minimum and maximum by sensor, as one SQL statement."""
    return messages.sparkSession.sql(
        f"""
        SELECT sensor_type, count(value) AS cnt, {exact_sum_sql('value')} AS total,
               min(value) AS min_value, max(value) AS max_value
        FROM {{messages}}
        WHERE ts_ms BETWEEN :from_ms AND :to_ms
          AND event_date BETWEEN date_add(DATE'1970-01-01', CAST(floor(:from_ms / {MS_PER_DAY}) AS INT))
                             AND date_add(DATE'1970-01-01', CAST(floor(:to_ms / {MS_PER_DAY}) AS INT))
        GROUP BY sensor_type
        """,
        args={"from_ms": from_ms, "to_ms": to_ms},
        messages=messages,
    )


def rollup(messages: DataFrame) -> DataFrame:
    """One partial per second and sensor."""
    # A second lies within one day, so the day needs no place among the keys.
    return partials(messages, "bucket", "sensor_type").withColumn(
        "event_date",
        F.expr(f"date_add(DATE'1970-01-01', cast(floor(bucket / {MS_PER_DAY // MS_PER_SECOND}) as int))"),
    )


def padded_synthesis(parts: DataFrame) -> DataFrame:
    """As ``synthesis_of``, with a row of zeros for every absent sensor of
    ``PADDED_SENSORS``; sensors outside that range stay.

    The listed sensors join the merge as empty partials (no minimum, no maximum,
    count 0), so padding costs neither a join nor another shuffle.
    """
    spark = parts.sparkSession
    empty = spark.range(PADDED_SENSORS.start, PADDED_SENSORS.stop, numPartitions=1).selectExpr(
        "cast(id as int) AS sensor_type",
        "cast(NULL as bigint) AS min_value",
        "cast(NULL as bigint) AS max_value",
        "cast(0 as decimal(38,0)) AS total",
        "0L AS cnt",
    )
    merged = merge_partials(
        parts.select("sensor_type", *PARTIAL_VALUES).unionByName(empty), "sensor_type"
    )
    filled = merged.select(
        "sensor_type",
        F.coalesce("min_value", F.lit(0)).alias("min_value"),
        F.coalesce("max_value", F.lit(0)).alias("max_value"),
        "total",
        F.when(F.col("cnt") == 0, F.lit(PADDED_COUNT)).otherwise(F.col("cnt")).alias("cnt"),
    )
    return finish(filled, "sensor_type").orderBy("sensor_type")
