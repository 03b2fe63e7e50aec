from decimal import Decimal as D

import expected
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pulsegrid.functions.exact import exact_average, rounded_average
from pulsegrid.operators import filters, hybrid, ordering, render, synthesis

B = 1_463_738_400_000  # 2016-05-20T10:00:00Z
MAX, MIN = 2**63 - 1, -(2**63)


@pytest.mark.parametrize(
    "rows, from_ms, to_ms, want",
    [
        ([(B, 1, 5), (B + 1000, 1, 7)], B, B + 1000, [(1, 5, 7, D("6.00"), 2)]),
        ([(B + 10, 1, 4)], B, B + 20, [(1, 4, 4, D("4.00"), 1)]),
        ([(B, 1, 9)], B, B, [(1, 9, 9, D("9.00"), 1)]),
        ([(B, 1, 1), (B, 1, 2)], B, B, [(1, 1, 2, D("1.50"), 2)]),
        ([(B, 1, MAX)] * 3, B, B, [(1, MAX, MAX, D("9223372036854775807.00"), 3)]),
        ([(B, 1, MIN)] * 2, B, B, [(1, MIN, MIN, D("-9223372036854775808.00"), 2)]),
        ([(B, 1, -1005)] + [(B, 1, 0)] * 999, B, B, [(1, -1005, 0, D("-1.01"), 1000)]),
        ([(B, 1, 5)], B + 1, B + 9, []),
    ],
)
def test_edges_raw_and_hybrid(messages_of, rows, from_ms, to_ms, want):
    messages = messages_of(rows)
    assert rows_of(synthesis.synthesis(messages, from_ms, to_ms)) == want
    hybrid_rows = hybrid.hybrid_synthesis(messages, synthesis.rollup(messages), from_ms, to_ms)
    assert rows_of(hybrid_rows) == want


def test_half_open_leaves_the_end_out(messages_of):
    messages = messages_of([(B, 1, 5), (B + 1000, 1, 7)])
    assert rows_of(synthesis.rounded_synthesis(messages, B, B + 1000)) == [(1, 5, 5, 5)]


def test_averages_of_totals(spark):
    cases = [
        # total, cnt, two decimals, whole
        (1_000_000, 200_000_001, "0.00", 0),
        (-3, 2, "-1.50", -1),
        (3, 2, "1.50", 2),
        (-5, 2, "-2.50", -2),
        (-1005, 1000, "-1.01", -1),
        (0, 7, "0.00", 0),
        (MAX, 1, str(MAX) + ".00", MAX),
        (MIN, 1, str(MIN) + ".00", MIN),
        (MAX * 3, 3, str(MAX) + ".00", MAX),
        (10, 3, "3.33", 3),
        (20, 3, "6.67", 7),
    ]
    table = spark.createDataFrame(
        [(D(total), cnt) for total, cnt, *_ in cases], "total DECIMAL(38,0), cnt BIGINT"
    )
    got = table.select(exact_average("total", "cnt"), rounded_average("total", "cnt")).collect()
    assert [tuple(row) for row in got] == [(D(exact), whole) for *_, exact, whole in cases]


def test_exact_sum_is_the_decimal_sum(spark):
    values = spark.range(20_000).select(F.xxhash64("id").alias("value"))
    got = synthesis.partials(values).first()
    want = values.agg(F.sum(F.col("value").cast("decimal(28,0)"))).first()[0]
    assert got["total"] == want


def test_partials_merge_to_the_whole_however_split(messages_of):
    rows = [(B + 37 * n, n % 4, n * n - 500) for n in range(400)]
    messages = messages_of(rows)
    want = expected.synthesis(rows, B, B + 10**6)
    for pieces in (1, 2, 7):
        parts = [
            synthesis.partials(messages.filter(F.col("seq") % pieces == n), "sensor_type")
            for n in range(pieces)
        ]
        assert rows_of(synthesis.synthesis_of(synthesis.union_all(*parts))) == want


def test_sql_summary_is_the_partial(messages_of):
    rows = [(B + 250 * n, n % 3, n - 10) for n in range(60)]
    messages = messages_of(rows)
    sql = synthesis.sql_summary(messages, B + 250, B + 9000)
    api = synthesis.partials(filters.within(messages, B + 250, B + 9000), "sensor_type")
    assert rows_of(sql.select(sorted(sql.columns))) == rows_of(api.select(sorted(api.columns)))


def test_padding(messages_of):
    messages = messages_of([(B, 3, 8), (B, 42, -1)])
    got = rows_of(synthesis.padded_synthesis(synthesis.partials(messages, "sensor_type")))
    absent = [(n, 0, 0, D("0.00"), 1) for n in range(1, 11) if n != 3]
    assert got == sorted([(3, 8, 8, D("8.00"), 1), (42, -1, -1, D("-1.00"), 1), *absent])


def test_guard_skips_rows_without_sensor_or_value(spark, messages_of):
    messages = messages_of([(B, 1, 5), (B, None, 6), (B, 1, None)])
    assert rows_of(synthesis.guarded_synthesis(messages, B, B)) == [(1, 5, 5, D("5.00"), 1)]


def test_bounds():
    assert filters.bounds(as_of_ms=B) == (B - 3_600_000, B)
    assert filters.bounds(B, 3_000_000, as_of_ms=0) == (B, B + 3_000_000_000)


def test_trailing_hour_and_retention(messages_of):
    hour = 3_600_000
    messages = messages_of([(B - hour - 1, 1, 1), (B - hour, 1, 2), (B - 1, 1, 3), (B, 1, 4)])
    values = lambda df: [row[0] for row in rows_of(df.select("value"))]
    assert values(filters.trailing_hour(messages, B)) == [2, 3]
    assert values(filters.retained(messages, B)) == [2, 3, 4]


def test_times_before_1970(messages_of):
    rows = [(-1, 1, 5), (-1000, 1, 6), (-1001, 1, 7), (0, 1, 8)]
    messages = messages_of(rows)
    buckets = {(row["ts_ms"], row["bucket"]) for row in messages.collect()}
    assert buckets == {(-1, -1), (-1000, -1), (-1001, -2), (0, 0)}
    assert str(messages.filter("ts_ms = -1").first()["event_date"]) == "1969-12-31"
    want = expected.synthesis(rows, -1001, 0)
    got = hybrid.hybrid_synthesis(messages, synthesis.rollup(messages), -1001, 0)
    assert rows_of(got) == want


def test_json(messages_of):
    messages = messages_of([(B, 2, 3), (B, 1, 10), (B, 1, 11)])
    answer = synthesis.synthesis(messages, B, B)
    want = (
        '[{"sensorType":1,"minValue":10,"maxValue":11,"mediumValue":10.50,"count":2},'
        '{"sensorType":2,"minValue":3,"maxValue":3,"mediumValue":3.00,"count":1}]'
    )
    assert render.json_reply(answer).first()[0] == want
    rounded = synthesis.rounded_synthesis(messages, B, B + 1)
    assert render.json_rows(rounded.filter("sensor_type = 2")).first()[0] == (
        '{"sensorType":2,"minValue":3,"maxValue":3,"mediumValue":3}'
    )
    empty = synthesis.synthesis(messages, B + 5, B + 6)
    assert render.json_reply(empty).first()[0] == "[]"


def test_order(messages_of):
    messages = messages_of([(B + 5, 1, 0), (B, 1, 1), (B, 1, 2), (B - 7, 1, 3)])
    scan = [(row["ts_ms"], row["seq"]) for row in ordering.ordered_scan(messages).collect()]
    assert scan == [(B - 7, 3), (B, 1), (B, 2), (B + 5, 0)]
    assert ordering.oldest(messages).first()["value"] == 3
