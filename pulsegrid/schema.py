"""Column layouts shared by every module."""

from pyspark.sql import types as T

MESSAGE_KEY = ["ts_ms", "seq"]

MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("sensor_type", T.IntegerType()),
        T.StructField("value", T.LongType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)

PARTIAL_VALUES = ["min_value", "max_value", "total", "cnt"]

ROLLUP = T.StructType(
    [
        T.StructField("bucket", T.LongType()),
        T.StructField("sensor_type", T.IntegerType()),
        T.StructField("min_value", T.LongType()),
        T.StructField("max_value", T.LongType()),
        T.StructField("total", T.DecimalType(38, 0)),
        T.StructField("cnt", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)

IDS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("id_bucket", T.IntegerType()),
        T.StructField("event_date", T.DateType()),
    ]
)

QUARANTINE = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("ingest_ts", T.TimestampType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("from_ms", T.LongType()),
        T.StructField("to_ms", T.LongType()),
    ]
)

SYNTHESIS = T.StructType(
    [
        T.StructField("sensor_type", T.IntegerType()),
        T.StructField("min_value", T.LongType()),
        T.StructField("max_value", T.LongType()),
        T.StructField("medium_value", T.DecimalType(21, 2)),
        T.StructField("count", T.LongType()),
    ]
)

REQUEST_SYNTHESIS = T.StructType([T.StructField("request_id", T.StringType()), *SYNTHESIS.fields])

# Where a raw row came from, in the order of arrival: when its file was last changed, the
# file, and the block of it. Rows of one block are read in order by one task.
ARRIVAL = ["arrived", "source", "block"]


def message_columns() -> list[str]:
    return MESSAGES.fieldNames()
