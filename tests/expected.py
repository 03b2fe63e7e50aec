"""Plain Python answers to compare with."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal


def average(values):
    total = Decimal(sum(values))
    return (total / len(values)).quantize(Decimal("0.01"), ROUND_HALF_UP)


def synthesis(rows, from_ms, to_ms):
    by_sensor = defaultdict(list)
    for ts, sensor, value in rows:
        if from_ms <= ts <= to_ms:
            by_sensor[sensor].append(value)
    return [
        (sensor, min(vs), max(vs), average(vs), len(vs)) for sensor, vs in sorted(by_sensor.items())
    ]
