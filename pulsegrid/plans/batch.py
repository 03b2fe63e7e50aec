"""Registered queries that read the tables as a batch."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.operators import filters, hybrid, identity, ordering, render, synthesis
from pulsegrid.operators import requests as many
from pulsegrid.plans.catalog import (
    MESSAGE_COLUMNS,
    MESSAGES_SQL,
    REQUESTS_SQL,
    SHIPMENTS_SQL,
    Query,
    requests_sql,
    rollup_sql,
    rounded_average_sql,
    synthesis_sql,
)
from pulsegrid.schema import message_columns
from pulsegrid.session import written
from pulsegrid.sources import tables
from pulsegrid.sources.messages import accepted, quarantined, read_messages
from pulsegrid.sources.request_log import read_requests, readable_requests

# 2024-01-10T06:30:15.250Z to 2024-01-13T18:45:30.750Z: neither end on a second.
FROM_MS, TO_MS = 1_704_868_215_250, 1_705_171_530_750
# 2024-01-15T12:00:00Z, the "now" of queries that ask for the latest hour.
AS_OF_MS = 1_705_320_000_000
# Hot and cold store overlap in the two days between these.
HOT_FROM, COLD_UNTIL = date(2024, 1, 20), date(2024, 1, 22)
# Shipments before this day count as stored, later ones as arriving.
STORED_UNTIL = date(1999, 1, 1)


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.synthesis(tables.messages(spark, sf_dir, FROM_MS, TO_MS), FROM_MS, TO_MS)


def _rounded(spark, sf_dir):
    rows = tables.messages(spark, sf_dir, FROM_MS, TO_MS - 1)
    return synthesis.rounded_synthesis(rows, FROM_MS, TO_MS)


def _trailing_hour(spark, sf_dir):
    start = AS_OF_MS - filters.MS_PER_HOUR
    rows = tables.messages(spark, sf_dir, start, AS_OF_MS - 1)
    return synthesis.rounded_synthesis(rows, start, AS_OF_MS)


def _default_bounds(spark, sf_dir):
    bounds = filters.bounds(as_of_ms=AS_OF_MS)
    return synthesis.synthesis(tables.messages(spark, sf_dir, *bounds), *bounds)


def _sql_summary(spark, sf_dir):
    return synthesis.sql_summary(tables.messages(spark, sf_dir, FROM_MS, TO_MS), FROM_MS, TO_MS)


def _with_gaps(spark, sf_dir):
    """Messages of which every seventh lacks its sensor, every eleventh its value."""
    keep = lambda column, every: F.when(F.col("seq") % every != 0, F.col(column))
    return tables.messages(spark, sf_dir, FROM_MS, TO_MS).withColumns(
        {"sensor_type": keep("sensor_type", 7), "value": keep("value", 11)}
    )


def _null_guard(spark, sf_dir):
    return synthesis.guarded_synthesis(_with_gaps(spark, sf_dir), FROM_MS, TO_MS)


def _rollup(spark, sf_dir):
    return synthesis.rollup(tables.messages(spark, sf_dir))


def _merge_partials(spark, sf_dir):
    """Events and shipments, each by day and sensor, merged by sensor."""
    sides = [tables.messages(spark, sf_dir), tables.shipments(spark, sf_dir)]
    daily = [synthesis.partials(side, "event_date", "sensor_type") for side in sides]
    return synthesis.merge_partials(synthesis.union_all(*daily), "sensor_type")


def _hybrid(spark, sf_dir):
    rows = tables.messages(spark, sf_dir, FROM_MS, TO_MS)
    return hybrid.hybrid_synthesis(rows, synthesis.rollup(rows), FROM_MS, TO_MS)


def _hot_and_cold(spark, sf_dir):
    rows, days = tables.messages(spark, sf_dir), F.col("event_date")
    return rows.filter(days >= F.lit(HOT_FROM)), rows.filter(days < F.lit(COLD_UNTIL))


def _evict(spark, sf_dir):
    return identity.evict_persisted(*_hot_and_cold(spark, sf_dir))


def _hot_cold(spark, sf_dir):
    hot, cold = _hot_and_cold(spark, sf_dir)
    rest = identity.evict_persisted(hot, cold)
    return hybrid.hot_cold_synthesis(rest, cold, FROM_MS, TO_MS + 14 * 86_400_000)


def _padded(spark, sf_dir):
    """Sensors doubled: the odd ones below ten are absent, some exceed ten."""
    rows = tables.messages(spark, sf_dir).withColumn("sensor_type", F.col("sensor_type") * 2)
    return synthesis.padded_synthesis(synthesis.partials(rows, "sensor_type"))


def _message_count(spark, sf_dir):
    return tables.messages(spark, sf_dir).agg(F.count(F.lit(1)).alias("messages"))


def _requests(spark, sf_dir):
    rows = tables.messages(spark, sf_dir)
    return many.synthesis_requests(rows, synthesis.rollup(rows), tables.requests(spark, sf_dir))


def _requests_json(spark, sf_dir):
    rows = tables.messages(spark, sf_dir)
    answers = many.listed_requests(rows, synthesis.rollup(rows), tables.requests(spark, sf_dir))
    return render.json_listed(answers, "request_id")


def _dedup_first(spark, sf_dir):
    return identity.first_by_id(tables.shipments(spark, sf_dir), _TOTAL_ORDER)


def _dedup_repeats(spark, sf_dir):
    return identity.repeated_ids(tables.shipments(spark, sf_dir), _TOTAL_ORDER)


_TOTAL_ORDER = ["ts_ms", "seq", "value"]


def _arriving_and_stored(spark, sf_dir):
    rows, days = tables.shipments(spark, sf_dir), F.col("event_date")
    return rows.filter(days >= F.lit(STORED_UNTIL)), rows.filter(days < F.lit(STORED_UNTIL))


def _ids_known(spark, sf_dir):
    arriving, stored = _arriving_and_stored(spark, sf_dir)
    return identity.known_ids(arriving, stored).select(*message_columns())


def _ids_new(spark, sf_dir):
    arriving, stored = _arriving_and_stored(spark, sf_dir)
    return identity.new_ids(arriving, stored).select(*message_columns())


def _upsert_last(spark, sf_dir):
    """Last shipment per day and sensor."""
    arrival = [F.desc("id"), F.desc("seq"), F.desc("value")]
    rows = tables.shipments(spark, sf_dir)
    return identity.upsert_last(rows, arrival, keys=["ts_ms", "sensor_type"])


def _retention(spark, sf_dir):
    return filters.retained(tables.messages(spark, sf_dir), AS_OF_MS)


def _oldest(spark, sf_dir):
    return ordering.oldest(tables.messages(spark, sf_dir))


def _ordered_scan(spark, sf_dir):
    return ordering.ordered_scan(tables.messages(spark, sf_dir))


# ``seq`` is assigned on arrival and has no SQL counterpart.
_PARSED = ["id", "ts_ms", "sensor_type", "value", "bucket", "event_date"]


def _read_with_defects(spark, sf_dir, **options):
    return read_messages(tables.raw_with_defects(tables.messages(spark, sf_dir)), **options)


def _parse(spark, sf_dir):
    return accepted(_read_with_defects(spark, sf_dir, require_id=True)).select(*_PARSED)


def _parse_any(spark, sf_dir):
    raw = tables.raw_with_numeric_times(tables.messages(spark, sf_dir))
    return accepted(read_messages(raw, timestamp="any")).select(*_PARSED)


def _parse_zero(spark, sf_dir):
    read = _read_with_defects(spark, sf_dir, on_missing="zero")
    return accepted(read).select(*_PARSED)


def _quarantine(spark, sf_dir):
    bad = quarantined(_read_with_defects(spark, sf_dir, require_id=True))
    return bad.select(F.regexp_extract("raw", r'"id":"(\d+)"', 1).alias("id"), "reason")


def _request_log(spark, sf_dir):
    read = read_requests(tables.request_log(spark, sf_dir), AS_OF_MS)
    return readable_requests(read)


def _logged_requests(spark, sf_dir):
    """The logged requests, parsed once and answered."""
    rows = tables.messages(spark, sf_dir)
    asked = written(_request_log(spark, sf_dir), "requests")
    return many.synthesis_requests(rows, synthesis.rollup(rows), asked)


def _json(spark, sf_dir):
    return render.json_reply(_range(spark, sf_dir))


def _json_rows(spark, sf_dir):
    return render.json_rows(_range(spark, sf_dir), "sensor_type")


_WITH_MESSAGES = f"WITH {MESSAGES_SQL}"
_WITH_SHIPMENTS = f"WITH {SHIPMENTS_SQL}"
_IN_RANGE = f"ts_ms BETWEEN {FROM_MS} AND {TO_MS}"

_GOOD_DEFECTS = "6, 7, 9, 10"
_BAD_DEFECTS = "1, 2, 3, 4, 5, 8"

_LOGGED_SQL = f"""{REQUESTS_SQL},
logged AS (
  SELECT request_id, from_ms, CASE status WHEN 'F' THEN from_ms + 3600000 ELSE to_ms END AS to_ms
  FROM requests)"""


def _json_object_sql() -> str:
    return (
        "'{\"sensorType\":' || sensor_type || ',\"minValue\":' || min_value || ',\"maxValue\":' || "
        "max_value || ',\"mediumValue\":' || medium_value || ',\"count\":' || count || '}'"
    )


def _parsed_sql(ts: str = "ts_ms", value: str = "value") -> str:
    return (
        f"SELECT id, ts_ms, sensor_type, value, ts_ms // 1000 AS bucket, "
        f"CAST(epoch_ms(ts_ms) AS DATE) AS event_date FROM "
        f"(SELECT id, seq, sensor_type, {ts} AS ts_ms, {value} AS value FROM messages)"
    )


_SHIFTED = "CASE WHEN seq % 50 = 10 THEN ts_ms - 7200000 ELSE ts_ms END"

QUERIES = {
    "synthesis_range": Query(
        _range, f"{_WITH_MESSAGES} {synthesis_sql(f'messages WHERE {_IN_RANGE}')}"
    ),
    "synthesis_halfopen_rounded": Query(
        _rounded,
        f"""{_WITH_MESSAGES} SELECT sensor_type, min_value, max_value,
            {rounded_average_sql()} AS medium_value
        FROM (SELECT sensor_type, min(value) AS min_value, max(value) AS max_value,
                     sum(value) AS total, count(*) AS cnt
              FROM messages WHERE ts_ms >= {FROM_MS} AND ts_ms < {TO_MS} GROUP BY sensor_type)""",
    ),
    "synthesis_trailing_hour": Query(
        _trailing_hour,
        f"""{_WITH_MESSAGES} SELECT sensor_type, min_value, max_value,
            {rounded_average_sql()} AS medium_value
        FROM (SELECT sensor_type, min(value) AS min_value, max(value) AS max_value,
                     sum(value) AS total, count(*) AS cnt
              FROM messages WHERE ts_ms >= {AS_OF_MS - 3_600_000} AND ts_ms < {AS_OF_MS}
              GROUP BY sensor_type)""",
    ),
    "synthesis_default_bounds": Query(
        _default_bounds,
        _WITH_MESSAGES
        + synthesis_sql(f"messages WHERE ts_ms BETWEEN {AS_OF_MS - 3_600_000} AND {AS_OF_MS}"),
    ),
    "sql_summary": Query(
        _sql_summary,
        f"""{_WITH_MESSAGES} SELECT sensor_type, count(*) AS cnt,
            CAST(sum(value) AS DECIMAL(38,0)) AS total, min(value) AS min_value,
            max(value) AS max_value
        FROM messages WHERE {_IN_RANGE} GROUP BY sensor_type""",
    ),
    "synthesis_null_guard": Query(
        _null_guard,
        _WITH_MESSAGES
        + synthesis_sql(f"messages WHERE {_IN_RANGE} AND seq % 7 <> 0 AND seq % 11 <> 0"),
    ),
    "rollup_1s": Query(_rollup, _WITH_MESSAGES + rollup_sql("messages")),
    "merge_partials": Query(
        _merge_partials,
        f"""WITH {MESSAGES_SQL}, {SHIPMENTS_SQL}
        SELECT sensor_type, min(value) AS min_value, max(value) AS max_value,
               CAST(sum(value) AS DECIMAL(38,0)) AS total, CAST(count(*) AS BIGINT) AS cnt
        FROM (SELECT sensor_type, value FROM messages
              UNION ALL SELECT sensor_type, value FROM shipments) GROUP BY sensor_type""",
    ),
    "synthesis_hybrid": Query(
        _hybrid, f"{_WITH_MESSAGES} {synthesis_sql(f'messages WHERE {_IN_RANGE}')}"
    ),
    "evict_persisted": Query(
        _evict,
        f"{_WITH_MESSAGES} SELECT {MESSAGE_COLUMNS} FROM messages "
        f"WHERE event_date >= DATE '{COLD_UNTIL}'",
    ),
    "synthesis_hot_cold": Query(
        _hot_cold,
        _WITH_MESSAGES
        + synthesis_sql(
            f"messages WHERE ts_ms BETWEEN {FROM_MS} AND {TO_MS + 14 * 86_400_000}"
        ),
    ),
    "synthesis_padded": Query(
        _padded,
        f"""{_WITH_MESSAGES}, answer AS ({synthesis_sql(
            "(SELECT sensor_type * 2 AS sensor_type, value FROM messages)")})
        SELECT CAST(coalesce(a.sensor_type, p.sensor_type) AS INTEGER) AS sensor_type,
               CAST(coalesce(min_value, 0) AS BIGINT) AS min_value,
               CAST(coalesce(max_value, 0) AS BIGINT) AS max_value,
               CAST(coalesce(medium_value, 0) AS DECIMAL(21,2)) AS medium_value,
               CAST(coalesce(count, 1) AS BIGINT) AS count
        FROM answer a FULL OUTER JOIN (SELECT range AS sensor_type FROM range(1, 11)) p
          ON a.sensor_type = p.sensor_type""",
    ),
    "message_count": Query(_message_count, "SELECT count(*) AS messages FROM events"),
    "synthesis_requests": Query(
        _requests, f"WITH {MESSAGES_SQL}, {REQUESTS_SQL} {requests_sql('requests')}"
    ),
    "synthesis_requests_json": Query(
        _requests_json,
        f"""WITH {MESSAGES_SQL}, {REQUESTS_SQL}, answer AS ({requests_sql('requests')})
        SELECT request_id,
               '[' || string_agg({_json_object_sql()}, ',' ORDER BY sensor_type) || ']' AS json
        FROM answer GROUP BY request_id""",
    ),
    "dedup_first": Query(
        _dedup_first,
        f"""{_WITH_SHIPMENTS} SELECT {MESSAGE_COLUMNS} FROM shipments
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_ms, seq, value) = 1""",
    ),
    "dedup_repeats": Query(
        _dedup_repeats,
        f"""{_WITH_SHIPMENTS} SELECT {MESSAGE_COLUMNS} FROM shipments
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_ms, seq, value) > 1""",
    ),
    "ids_known": Query(
        _ids_known,
        f"""{_WITH_SHIPMENTS} SELECT {MESSAGE_COLUMNS} FROM shipments
        WHERE event_date >= DATE '{STORED_UNTIL}'
          AND id IN (SELECT id FROM shipments WHERE event_date < DATE '{STORED_UNTIL}')""",
    ),
    "ids_new": Query(
        _ids_new,
        f"""{_WITH_SHIPMENTS} SELECT {MESSAGE_COLUMNS} FROM shipments
        WHERE event_date >= DATE '{STORED_UNTIL}'
          AND id NOT IN (SELECT id FROM shipments WHERE event_date < DATE '{STORED_UNTIL}')""",
    ),
    "upsert_last": Query(
        _upsert_last,
        f"""{_WITH_SHIPMENTS} SELECT {MESSAGE_COLUMNS} FROM shipments
        QUALIFY row_number() OVER (PARTITION BY ts_ms, sensor_type
                                   ORDER BY id DESC, seq DESC, value DESC) = 1""",
    ),
    "retention": Query(
        _retention,
        f"{_WITH_MESSAGES} SELECT {MESSAGE_COLUMNS} FROM messages "
        f"WHERE ts_ms >= {AS_OF_MS - 3_600_000}",
    ),
    "oldest_message": Query(
        _oldest,
        f"{_WITH_MESSAGES} SELECT {MESSAGE_COLUMNS} FROM messages ORDER BY ts_ms, seq LIMIT 1",
    ),
    "ordered_scan": Query(
        _ordered_scan,
        f"{_WITH_MESSAGES} SELECT {MESSAGE_COLUMNS} FROM messages ORDER BY ts_ms, seq",
    ),
    "parse_messages": Query(
        _parse,
        f"{_WITH_MESSAGES} {_parsed_sql(_SHIFTED)} WHERE seq % 50 NOT IN ({_BAD_DEFECTS})",
    ),
    "parse_any_timestamp": Query(_parse_any, f"{_WITH_MESSAGES} {_parsed_sql()}"),
    "parse_zero_fill": Query(
        _parse_zero,
        f"""{_WITH_MESSAGES}
        {_parsed_sql(_SHIFTED, 'CASE WHEN seq % 50 = 2 THEN 0 ELSE value END')}
        WHERE seq % 50 NOT IN (1, 3, 4, 5, 8)""",
    ),
    "quarantine": Query(
        _quarantine,
        f"""SELECT CASE WHEN event_id % 50 = 8 THEN '' ELSE CAST(event_id AS VARCHAR) END AS id,
            CASE event_id % 50 WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'missing_field'
                 WHEN 3 THEN 'bad_timestamp' WHEN 4 THEN 'bad_number' WHEN 5 THEN 'bad_number'
                 ELSE 'malformed_json' END AS reason
        FROM events WHERE event_id % 50 IN ({_BAD_DEFECTS})""",
    ),
    "request_log": Query(
        _request_log, f"WITH {_LOGGED_SQL} SELECT request_id, from_ms, to_ms FROM logged"
    ),
    "request_log_answers": Query(
        _logged_requests, f"WITH {MESSAGES_SQL}, {_LOGGED_SQL} {requests_sql('logged')}"
    ),
    "synthesis_json": Query(
        _json,
        f"""{_WITH_MESSAGES}, answer AS ({synthesis_sql(f'messages WHERE {_IN_RANGE}')})
        SELECT '[' || string_agg({_json_object_sql()}, ',' ORDER BY sensor_type) || ']' AS json
        FROM answer""",
    ),
    "synthesis_json_rows": Query(
        _json_rows,
        f"""{_WITH_MESSAGES}, answer AS ({synthesis_sql(f'messages WHERE {_IN_RANGE}')})
        SELECT sensor_type, {_json_object_sql()} AS json FROM answer""",
    ),
}
