"""Event time: ISO text, epoch milliseconds, one-second buckets, days."""

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

MS_PER_SECOND = 1_000
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000

# Years 0001 to 9999; Spark dates and timestamps outside it are not portable.
MIN_MS = -62_135_596_800_000
MAX_MS = 253_402_300_799_999

_EPOCH = date(1970, 1, 1)


def iso_to_ms(text: Column) -> Column:
    """ISO-8601 text to epoch ms, NULL if unreadable.

    The text must start with a year: a bare time of day would be completed with
    the current date, which no stored event means.
    """
    parsed = F.unix_millis(F.try_to_timestamp(text))
    return F.when(text.rlike(r"^[+-]?\d{4}") & parsed.between(MIN_MS, MAX_MS), parsed)


def ms_to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def floor_div(value: Column, size: int) -> Column:
    """Integer division rounding down, also before 1970."""
    rest = F.pmod(value, F.lit(size))
    return F.call_function("div", value - rest, F.lit(size))


def bucket_of(ts_ms: Column) -> Column:
    return floor_div(ts_ms, MS_PER_SECOND)


def date_of(ts_ms: Column) -> Column:
    """Day of an epoch-ms column, whatever the session time zone."""
    return F.date_add(F.lit(_EPOCH), floor_div(ts_ms, MS_PER_DAY).cast("int"))


def day(ms: int) -> Column:
    """Day of a literal bound, clipped to the supported years."""
    found = _EPOCH + timedelta(days=min(max(ms, MIN_MS), MAX_MS) // MS_PER_DAY)
    return F.lit(found.isoformat()).cast("date")


def with_time_columns(df):
    """Add ``bucket`` and ``event_date``, both derived from ``ts_ms``."""
    ts_ms = F.col("ts_ms")
    return df.withColumns({"bucket": bucket_of(ts_ms), "event_date": date_of(ts_ms)})
