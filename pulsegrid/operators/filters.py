"""Time bounds, retention and the missing-field guard.

Bounds are epoch milliseconds. Every range filter also constrains
``event_date``, so tables partitioned by day are pruned without the caller
having to repeat the bounds.
"""

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.timeaxis import MS_PER_HOUR, MS_PER_SECOND, day

DEFAULT_DURATION_S = 3_600


def bounds(from_ms: int | None = None, duration_s: int | None = None, *, as_of_ms: int) -> tuple[int, int]:
    """Closed bounds of a request: one hour before ``as_of_ms``, for one hour,
    wherever the request leaves them open."""
    start = as_of_ms - MS_PER_HOUR if from_ms is None else from_ms
    seconds = DEFAULT_DURATION_S if duration_s is None else duration_s
    return start, start + MS_PER_SECOND * seconds


def date_range(from_ms: int, to_ms: int) -> Column:
    """The days that ``[from_ms, to_ms]`` touches."""
    return F.col("event_date").between(day(from_ms), day(to_ms))


def closed_range(from_ms: int, to_ms: int) -> Column:
    """``[from_ms, to_ms]``: a message at exactly ``to_ms`` is in."""
    return date_range(from_ms, to_ms) & F.col("ts_ms").between(from_ms, to_ms)


def half_open_range(from_ms: int, to_ms: int) -> Column:
    """``[from_ms, to_ms)``: a message at exactly ``to_ms`` is out."""
    return closed_range(from_ms, to_ms - 1)


def within(messages: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return messages.filter(closed_range(from_ms, to_ms))


def within_half_open(messages: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return messages.filter(half_open_range(from_ms, to_ms))


def trailing_hour(messages: DataFrame, as_of_ms: int) -> DataFrame:
    """The hour before ``as_of_ms``, which itself is out."""
    return within_half_open(messages, as_of_ms - MS_PER_HOUR, as_of_ms)


def retained(messages: DataFrame, as_of_ms: int, keep_ms: int = MS_PER_HOUR) -> DataFrame:
    """Messages no older than ``keep_ms`` at ``as_of_ms``."""
    oldest = as_of_ms - keep_ms
    return messages.filter((F.col("event_date") >= day(oldest)) & (F.col("ts_ms") >= oldest))


def complete_rows(messages: DataFrame) -> DataFrame:
    """Rows that have both a sensor and a value."""
    return messages.dropna(subset=["sensor_type", "value"])
