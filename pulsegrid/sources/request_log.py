"""Synthesis requests from logged query strings."""

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.text import first_parameter, query_parameters
from pulsegrid.functions.timeaxis import MS_PER_HOUR, MS_PER_SECOND, iso_to_ms
from pulsegrid.operators.filters import DEFAULT_DURATION_S

BAD_DURATION = "bad_duration"
BAD_TIMESTAMP = "bad_timestamp"


def read_requests(log: DataFrame, as_of_ms: int) -> DataFrame:
    """Parse ``(request_id, query)``, e.g. ``timestamp=...&duration=60``.

    The first of repeated parameters counts. Without ``timestamp`` a request
    starts one hour before ``as_of_ms``; without ``duration`` it lasts an hour.
    Returns ``request_id, from_ms, to_ms, reason``; ``reason`` is NULL if both
    parameters are absent or readable.
    """
    given = log.withColumn("_params", query_parameters(F.col("query"))).select(
        "request_id",
        first_parameter(F.col("_params"), "timestamp").alias("timestamp"),
        first_parameter(F.col("_params"), "duration").alias("duration"),
    )
    read = given.withColumns(
        {
            "from_ms": F.when(F.col("timestamp").isNull(), F.lit(as_of_ms - MS_PER_HOUR)).otherwise(
                iso_to_ms(F.col("timestamp.value"))
            ),
            "seconds": F.when(F.col("duration").isNull(), F.lit(DEFAULT_DURATION_S)).otherwise(
                F.col("duration.value").try_cast("int")
            ),
        }
    )
    return read.select(
        "request_id",
        "from_ms",
        (F.col("from_ms") + F.col("seconds").cast("bigint") * MS_PER_SECOND).alias("to_ms"),
        F.when(F.col("from_ms").isNull(), BAD_TIMESTAMP)
        .when(F.col("seconds").isNull(), BAD_DURATION)
        .alias("reason"),
    )


def readable_requests(read: DataFrame) -> DataFrame:
    return read.filter("reason IS NULL").select("request_id", "from_ms", "to_ms")
