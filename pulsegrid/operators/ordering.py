"""Time order."""

from pyspark.sql import DataFrame

from pulsegrid.schema import MESSAGE_KEY


def ordered_scan(messages: DataFrame) -> DataFrame:
    """All messages by time, then arrival: a range-partitioned sort."""
    return messages.orderBy(*MESSAGE_KEY)


def oldest(messages: DataFrame) -> DataFrame:
    """The first message in time; each task keeps one candidate."""
    return messages.orderBy(*MESSAGE_KEY).limit(1)
