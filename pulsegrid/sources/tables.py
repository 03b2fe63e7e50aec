"""Sensor fixtures on top of the test tables."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions.timeaxis import with_time_columns
from pulsegrid.operators.filters import closed_range
from pulsegrid.schema import message_columns
from pulsegrid.session import prepare
from pulsegrid.sources.messages import wire_text

SENSORS = 10

# First request start and the span over which orders spread theirs, in ms.
REQUESTS_FROM_MS = 1_704_067_200_000
REQUESTS_SPAN_MS = 2_505_600_000
LONGEST_REQUEST_S = 7_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _sensor(number: str) -> Column:
    return (F.col(number) % SENSORS + 1).cast("int")


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def _zone_free(ms: int) -> Column:
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)
    return F.lit(at.replace(tzinfo=None).isoformat(" ", "milliseconds")).cast("timestamp_ntz")


def events_as_messages(events: DataFrame) -> DataFrame:
    """``events`` (batch or stream) as messages."""
    rows = events.select(
        F.col("event_id").cast("string").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_id").alias("seq"),
        _sensor("user_id").alias("sensor_type"),
        _cents("value").alias("value"),
    )
    return with_time_columns(rows).select(*message_columns())


def messages(
    spark: SparkSession, sf_dir: str, from_ms: int | None = None, to_ms: int | None = None
) -> DataFrame:
    """One message per event. With bounds, a condition on the stored time
    column reaches the Parquet scan, which cannot see through ``ts_ms``."""
    events = table(spark, sf_dir, "events")
    if from_ms is None:
        return events_as_messages(events)
    stored = (F.col("ts") >= _zone_free(from_ms)) & (F.col("ts") < _zone_free(to_ms + 1))
    return events_as_messages(events.filter(stored)).filter(closed_range(from_ms, to_ms))


def as_shipments(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` (batch or stream) as messages. Ids repeat, and ``seq`` (part and
    supplier) only orders the copies of one id and time."""
    rows = lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("seq"),
        _sensor("l_suppkey").alias("sensor_type"),
        _cents("l_extendedprice").alias("value"),
    )
    return with_time_columns(rows).select(*message_columns())


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per order line."""
    return as_shipments(table(spark, sf_dir, "lineitem"))


def raw_json(rows: DataFrame) -> DataFrame:
    """Messages as the JSON text they would arrive as."""
    return rows.select(wire_text().alias("raw"))


def raw_with_defects(rows: DataFrame) -> DataFrame:
    """As ``raw_json``, every message kept, some spoilt by ``seq % 50``."""
    text = wire_text()
    kind = F.col("seq") % 50
    iso = r'"timestamp":"[^"]*"'
    sensor = r'"sensorType":(\d+)'
    spoilt = (
        F.when(kind == 1, F.regexp_replace(text, r"\}$", ""))
        .when(kind == 2, F.regexp_replace(text, r',"value":-?\d+', ""))
        .when(kind == 3, F.regexp_replace(text, iso, '"timestamp":"yesterday"'))
        .when(kind == 4, F.regexp_replace(text, sensor, '"sensorType":99999999999'))
        .when(kind == 5, F.regexp_replace(text, r'"value":(-?\d+)', r'"value":$1.5'))
        .when(kind == 6, F.regexp_replace(text, sensor, r'"sensorType":"$1"'))
        .when(kind == 7, F.regexp_replace(text, r'"value":(-?\d+)', r'"value":$1.0'))
        .when(kind == 8, F.lit(""))
        .when(kind == 9, F.regexp_replace(text, r"\}$", ',"unit":"C","tags":[1,{"a":2}]}'))
        .when(kind == 10, F.regexp_replace(text, 'Z"', '+02:00"'))
        .otherwise(text)
    )
    return rows.select(spoilt.alias("raw"))


def raw_with_numeric_times(rows: DataFrame) -> DataFrame:
    """As ``raw_json``; odd ``seq`` carry epoch ms instead of ISO text."""
    numeric = F.to_json(
        F.struct(
            F.col("id"),
            F.col("ts_ms").alias("timestamp"),
            F.col("sensor_type").alias("sensorType"),
            F.col("value"),
        )
    )
    return rows.select(F.when(F.col("seq") % 2 == 1, numeric).otherwise(wire_text()).alias("raw"))


def _order_start() -> Column:
    spread = (F.col("o_orderkey") * 7_919_017) % REQUESTS_SPAN_MS
    return spread + F.lit(REQUESTS_FROM_MS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthesis request per order."""
    start = _order_start()
    seconds = F.col("o_custkey") % LONGEST_REQUEST_S
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        start.alias("from_ms"),
        (start + seconds * 1_000).alias("to_ms"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query string per order; its form follows the order status:
    F has no duration, P repeats it and adds an unknown parameter, O has both."""
    at = F.date_format(F.timestamp_millis(_order_start()), "yyyy-MM-dd'T'HH'%3A'mm'%3A'ss.SSS'Z'")
    seconds = (F.col("o_custkey") % LONGEST_REQUEST_S).cast("string")
    status = F.col("o_orderstatus")
    query = (
        F.when(status == "F", F.concat(F.lit("timestamp="), at))
        .when(
            status == "P",
            F.concat(F.lit("duration="), seconds, F.lit("&x&timestamp="), at, F.lit("&duration=soon")),
        )
        .otherwise(F.concat(F.lit("timestamp="), at, F.lit("&duration="), seconds))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"), query.alias("query")
    )
