"""Sensor messages from JSON text, with everything unreadable set aside."""

from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.text import whole_number
from pulsegrid.functions.timeaxis import MAX_MS, MIN_MS, iso_to_ms, ms_to_iso, with_time_columns
from pulsegrid.schema import ARRIVAL, message_columns

# Wire fields. All are read as text: the reader must accept "2" and 1.0 as numbers.
WIRE_SCHEMA = "id STRING, timestamp STRING, sensorType STRING, value STRING, _corrupt STRING"

MALFORMED_JSON = "malformed_json"
MISSING_FIELD = "missing_field"
BAD_TIMESTAMP = "bad_timestamp"
BAD_NUMBER = "bad_number"
DUPLICATE_ID = "duplicate_id"


def read_messages(
    raw: DataFrame,
    *,
    timestamp: Literal["iso", "any"] = "iso",
    require_id: bool = False,
    on_missing: Literal["reject", "zero"] = "reject",
) -> DataFrame:
    """Parse a table with a text column ``raw``.

    Returns the message columns, ``raw`` and ``reason``; ``reason`` is NULL for a
    good message. ``timestamp="any"`` also takes a number of epoch ms.
    ``on_missing="zero"`` reads absent fields as 0 instead of rejecting the
    message. Works on batch and streaming tables alike, but only a batch can be
    numbered: ``seq`` is NULL on a streaming table. Numbers are unique within ``raw`` and
    rise within each block it is read in; ``load_batch`` orders the blocks, by the columns
    of ``ARRIVAL`` if ``raw`` has them, which are handed on.
    """
    origin = [name for name in ARRIVAL if name in raw.columns]
    arrival = F.lit(None).cast("bigint") if raw.isStreaming else F.monotonically_increasing_id()
    fields = F.from_json(
        "raw", WIRE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    wire = raw.withColumn("_wire", fields).select("raw", *origin, "_wire.*")
    read = wire.withColumns(
        {
            "ts_ms": _event_time(timestamp),
            "sensor_type": whole_number(F.col("sensorType"), "int"),
            "wide_value": whole_number(F.col("value"), "bigint"),
        }
    ).withColumn("reason", _reason(require_id, on_missing))
    if on_missing == "zero":
        zeros = {name: 0 for name in ("ts_ms", "sensor_type", "wide_value")}
        read = read.fillna(zeros, subset=list(zeros))
    numbered = read.select(
        "id",
        "ts_ms",
        arrival.alias("seq"),
        "sensor_type",
        F.col("wide_value").alias("value"),
        "raw",
        "reason",
        *origin,
    )
    return with_time_columns(numbered).select(*message_columns(), "raw", "reason", *origin)


def _event_time(timestamp: str) -> Column:
    text = F.col("timestamp")
    if timestamp == "iso":
        return iso_to_ms(text)
    number = whole_number(text, "bigint")
    return F.when(number.between(MIN_MS, MAX_MS), number).otherwise(
        F.when(number.isNull(), iso_to_ms(text))
    )


def _reason(require_id: bool, on_missing: str) -> Column:
    names = ["timestamp", "sensorType", "value"] + (["id"] if require_id else [])
    nothing = F.coalesce(*[F.col(n) for n in ("id", "timestamp", "sensorType", "value")]).isNull()
    # Text that is no object leaves every field NULL; an empty line does not even
    # fill the corrupt column. "{}" is an object without fields.
    unreadable = F.col("_corrupt").isNotNull() | (nothing & ~F.col("raw").rlike(r"^\s*\{"))
    unreadable = F.coalesce(unreadable, F.lit(True))
    if on_missing == "zero":
        names = ["id"] if require_id else []
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    present = lambda name: F.col(name).isNotNull()
    return (
        F.when(unreadable, MALFORMED_JSON)
        .when(missing, MISSING_FIELD)
        .when(present("timestamp") & F.col("ts_ms").isNull(), BAD_TIMESTAMP)
        .when(
            (present("sensorType") & F.col("sensor_type").isNull())
            | (present("value") & F.col("wide_value").isNull()),
            BAD_NUMBER,
        )
    )


def accepted(read: DataFrame) -> DataFrame:
    """Good messages of ``read_messages``."""
    return read.filter("reason IS NULL").select(*message_columns())


def quarantined(read: DataFrame) -> DataFrame:
    """Rejected text of ``read_messages`` with the reason."""
    return read.filter("reason IS NOT NULL").select(
        "raw", "reason", F.current_timestamp().alias("ingest_ts")
    )


def wire_text() -> Column:
    """The JSON text of a message row."""
    return F.to_json(
        F.struct(
            F.col("id"),
            ms_to_iso(F.col("ts_ms")).alias("timestamp"),
            F.col("sensor_type").alias("sensorType"),
            F.col("value"),
        )
    )
