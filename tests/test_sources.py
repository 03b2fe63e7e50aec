import pytest

from pulsegrid.sources.messages import accepted, quarantined, read_messages
from pulsegrid.sources.request_log import read_requests

AS_OF = 1_705_320_000_000


def _raw(spark, *texts):
    return spark.createDataFrame([(text,) for text in texts], "raw STRING")


def _message(timestamp='"2016-05-20T10:00:00.123Z"', sensor="1", value="5"):
    return f'{{"id":"x","timestamp":{timestamp},"sensorType":{sensor},"value":{value}}}'


@pytest.mark.parametrize(
    "text, want",
    [
        (_message(), (1463738400123, 1, 5)),
        (_message('"2016-05-20T10:00:00.123+02:00"'), (1463731200123, 1, 5)),
        (_message('"2016-05-20T10:00:00"'), (1463738400000, 1, 5)),
        (_message('"2016-05-20"'), (1463702400000, 1, 5)),
        (_message(sensor='"2"'), (1463738400123, 2, 5)),
        (_message(value="1.0"), (1463738400123, 1, 1)),
        (_message(value="9223372036854775807"), (1463738400123, 1, 2**63 - 1)),
        (_message(value="-9223372036854775808"), (1463738400123, 1, -(2**63))),
        (_message()[:-1] + ',"extra":[1,{"a":null}]}', (1463738400123, 1, 5)),
        (_message(value="1.5"), "bad_number"),
        (_message(value="9223372036854775808"), "bad_number"),
        (_message(sensor="2147483648"), "bad_number"),
        (_message(sensor='{"a":1}'), "bad_number"),
        (_message('"yesterday"'), "bad_timestamp"),
        (_message('"10:00:00"'), "bad_timestamp"),
        (_message('"2016-13-40T00:00:00Z"'), "bad_timestamp"),
        ('{"timestamp":"2016-05-20T10:00:00Z","value":1}', "missing_field"),
        (_message(value="null"), "missing_field"),
        ("{}", "missing_field"),
        (_message()[:-1], "malformed_json"),
        ("", "malformed_json"),
        ("null", "malformed_json"),
        ("[1]", "malformed_json"),
        ("hello", "malformed_json"),
        (None, "malformed_json"),
    ],
)
def test_messages(spark, text, want):
    read = read_messages(_raw(spark, text))
    good = accepted(read).collect()
    bad = quarantined(read).collect()
    if isinstance(want, str):
        assert not good and [(row["raw"], row["reason"]) for row in bad] == [(text, want)]
    else:
        assert not bad
        assert [(row["ts_ms"], row["sensor_type"], row["value"]) for row in good] == [want]


def test_ids_and_arrival_order(spark):
    read = read_messages(_raw(spark, _message(), _message().replace('"x"', '"y"')))
    rows = accepted(read).collect()
    assert {row["id"] for row in rows} == {"x", "y"} and len({row["seq"] for row in rows}) == 2


def test_id_can_be_required(spark):
    text = '{"timestamp":"2016-05-20T10:00:00Z","sensorType":1,"value":1}'
    assert accepted(read_messages(_raw(spark, text))).count() == 1
    bad = quarantined(read_messages(_raw(spark, text), require_id=True)).first()
    assert bad["reason"] == "missing_field"


@pytest.mark.parametrize(
    "timestamp, want",
    [
        ("1463738400123", 1463738400123),
        ('"1463738400123"', 1463738400123),
        ("-5", -5),
        ('"2016-05-20T10:00:00.123Z"', 1463738400123),
        ("99999999999999999", None),
        ('"soon"', None),
    ],
)
def test_any_timestamp(spark, timestamp, want):
    read = read_messages(_raw(spark, _message(timestamp)), timestamp="any").first()
    assert (read["ts_ms"], read["reason"]) == (want, None if want is not None else "bad_timestamp")


def test_missing_fields_as_zero(spark):
    read = read_messages(_raw(spark, '{"id":"x"}', "", _message(value="1.5")), on_missing="zero")
    assert [(r["ts_ms"], r["sensor_type"], r["value"]) for r in accepted(read).collect()] == [(0, 0, 0)]
    assert {r["reason"] for r in quarantined(read).collect()} == {"malformed_json", "bad_number"}


@pytest.mark.parametrize(
    "query, want",
    [
        ("timestamp=2016-05-20T10%3A00%3A00Z&duration=60", (1463738400000, 1463738460000, None)),
        ("timestamp=2016-05-20T12%3A00%3A00%2B02%3A00&duration=0", (1463738400000, 1463738400000, None)),
        ("duration=60", (AS_OF - 3_600_000, AS_OF - 3_540_000, None)),
        ("timestamp=2016-05-20T10%3A00%3A00Z", (1463738400000, 1463742000000, None)),
        ("", (AS_OF - 3_600_000, AS_OF, None)),
        ("a=b&x", (AS_OF - 3_600_000, AS_OF, None)),
        ("duration=60&duration=soon", (AS_OF - 3_600_000, AS_OF - 3_540_000, None)),
        ("duration=3000000", (AS_OF - 3_600_000, AS_OF - 3_600_000 + 3_000_000_000, None)),
        ("timestamp=&duration=60", (None, None, "bad_timestamp")),
        ("duration=soon", (AS_OF - 3_600_000, None, "bad_duration")),
    ],
)
def test_request_log(spark, query, want):
    log = spark.createDataFrame([("r", query)], "request_id STRING, query STRING")
    row = read_requests(log, AS_OF).first()
    assert (row["from_ms"], row["to_ms"], row["reason"]) == want
