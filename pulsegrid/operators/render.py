"""Answers as JSON text."""

from pyspark.sql import Column, DataFrame, functions as F

# Field names and order of the wire format.
JSON_FIELDS = {
    "sensorType": "sensor_type",
    "minValue": "min_value",
    "maxValue": "max_value",
    "mediumValue": "medium_value",
    "count": "count",
}


def _fields(answer: DataFrame) -> Column:
    present = [(name, column) for name, column in JSON_FIELDS.items() if column in answer.columns]
    return F.struct(*[F.col(column).alias(name) for name, column in present])


def json_rows(answer: DataFrame, *keys: str) -> DataFrame:
    """One JSON object per sensor row."""
    return answer.select(*keys, F.to_json(_fields(answer)).alias("json"))


def json_reply(answer: DataFrame, *keys: str) -> DataFrame:
    """One JSON array per request (or over all rows), ordered by sensor.

    An array holds one object per sensor of one answer; ``json_rows`` is the
    form for bulk output.
    """
    objects = F.array_sort(F.collect_list(_fields(answer)))
    return answer.groupBy(*keys).agg(F.to_json(objects).alias("json"))


def json_listed(answers: DataFrame, *keys: str) -> DataFrame:
    """As ``json_reply``, of ``answers`` that are one list each, in the order of the list."""
    fields = ", ".join(f"'{name}', a.{column}" for name, column in JSON_FIELDS.items())
    objects = F.expr(f"transform(answers, a -> named_struct({fields}))")
    return answers.select(*keys, F.to_json(objects).alias("json"))
