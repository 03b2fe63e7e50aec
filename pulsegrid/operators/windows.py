"""Ranges answered inside the task that holds their window of time.

Time is cut into aligned windows of ``2**shift`` seconds. A range no longer than one
begins in its window and ends there or in the next one, so the task that gets both
windows' partials answers it alone: only ranges and partials are shuffled, never parts of
answers. Within a task, a sum over a range is the difference of two running sums, a minimum
that of the two blocks of ``2**k`` rows at its ends.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.timeaxis import MS_PER_SECOND, bucket_of

SECONDS, MILLISECONDS, RANGES = range(3)

# A window with more ranges than this is dealt to several tasks, each with its partials.
RANGES_PER_TASK = 200_000
# Ranges times sensors that are answered at once.
PAIRS_AT_ONCE = 1 << 17

PARTS = (
    "request_id STRING, parts ARRAY<STRUCT<sensor_type: INT, min_value: BIGINT, "
    "max_value: BIGINT, total: DECIMAL(38,0), cnt: BIGINT>>"
)

# A missing sensor is a sensor like others, and comes first.
_NO_SENSOR = -(1 << 40)
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
# Totals are added in limbs of 36 bits, the top one with the sign.
_LIMB = 36
_MASK = (1 << _LIMB) - 1


def answers_by_window(
    seconds: DataFrame, milliseconds: DataFrame, ranges: DataFrame, shift: int, tasks: int
) -> DataFrame:
    """Partials by sensor of every range, in one row a range: ``PARTS``, ordered by sensor;
    a range without any has no row.

    ``seconds`` and ``milliseconds`` have ``at, sensor_type`` and the partial, ``ranges``
    ``request_id, from_ms, to_ms, first``, the latter the second of ``from_ms``. No range is
    longer than ``2**shift`` seconds. A task holds the partials of two windows, of which one
    second has no more than a thousand a sensor, and ranges a batch at a time.
    """
    window = lambda second: F.shiftright(second, shift)
    none = lambda *columns: [F.lit(None).cast(t).alias(n) for n, t in columns]
    values = ["sensor_type", "min_value", "max_value", "total", "cnt"]

    def held(rows: DataFrame, kind: int, second: Column) -> DataFrame:
        own = window(second)
        return rows.select(
            F.explode(F.array(own - 1, own)).alias("window"),
            F.lit(kind).alias("kind"),
            "at",
            *values,
            *none(("request_id", "string"), ("to_ms", "bigint")),
        )

    data = held(seconds, SECONDS, F.col("at")).unionByName(
        held(milliseconds, MILLISECONDS, bucket_of(F.col("at")))
    )
    asked = ranges.select(
        window(F.col("first")).alias("window"),
        F.lit(RANGES).alias("kind"),
        F.col("from_ms").alias("at"),
        *none(("sensor_type", "int"), ("min_value", "bigint"), ("max_value", "bigint")),
        *none(("total", "decimal(38,0)"), ("cnt", "bigint")),
        "request_id",
        "to_ms",
    )
    counts = asked.groupBy("window").agg(F.count(F.lit(1)).alias("rows"))
    # Fewer than the number of ranges divided by RANGES_PER_TASK.
    heavy = counts.filter(F.col("rows") > RANGES_PER_TASK).collect()
    keys = ["window"]
    if heavy:
        shares = ranges.sparkSession.createDataFrame(
            [(r["window"], -(-r["rows"] // RANGES_PER_TASK)) for r in heavy], "window BIGINT, shares INT"
        )
        dealt = lambda rows: rows.join(F.broadcast(shares), "window", "left")
        share = F.coalesce(F.col("shares"), F.lit(1))
        data = dealt(data).withColumn("share", F.explode(F.sequence(F.lit(0), share - 1)))
        asked = dealt(asked).withColumn("share", F.pmod(F.xxhash64("request_id", "at"), share).cast("int"))
        keys.append("share")
    rows = data.unionByName(asked).repartition(tasks, *keys).sortWithinPartitions(*keys, "kind", "at")
    return rows.mapInArrow(lambda batches: _answered(batches, keys, shift), PARTS)


def _answered(batches: Iterator[pa.RecordBatch], keys: list[str], shift: int) -> Iterator[pa.RecordBatch]:
    current, window, held = None, None, []
    for batch in batches:
        ids = [batch.column(name).to_numpy() for name in (*keys, "kind")]
        changes = np.any([ids_[1:] != ids_[:-1] for ids_ in ids], axis=0)
        starts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            if start == end:
                continue
            key, kind = tuple(int(c[start]) for c in ids[:-1]), int(ids[-1][start])
            if key != current:
                current, window, held = key, None, []
            part = batch.slice(start, end - start)
            if kind != RANGES:
                held.append((kind, _Rows.read(part)))
            elif held:
                window = window or _Window(held, key[0], shift)
                yield from window.answers(part)


class _Rows(NamedTuple):
    at: np.ndarray
    sensor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    # Three limbs of the total and the count, a column each.
    sums: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> "_Rows":
        numbers = lambda name, null: batch.column(name).cast(pa.int64()).fill_null(null).to_numpy()
        total = batch.column("total")
        words = np.frombuffer(total.buffers()[1], np.int64)[2 * total.offset :][: 2 * len(total)].reshape(-1, 2)
        words = np.where(total.is_valid().to_numpy(zero_copy_only=False)[:, None], words, 0)
        low, high = words[:, 0], words[:, 1]
        middle = (low >> _LIMB) & ((1 << 64 - _LIMB) - 1) | (high & 255) << 64 - _LIMB
        sums = np.stack([low & _MASK, middle, high >> 8, numbers("cnt", 0)], axis=1)
        return cls(
            numbers("at", 0), numbers("sensor_type", _NO_SENSOR), numbers("min_value", _HIGH), numbers("max_value", _LOW), sums
        )

    @classmethod
    def joined(cls, parts: list["_Rows"]) -> "_Rows":
        none = np.empty(0, np.int64)
        return cls(*map(np.concatenate, zip(cls(none, none, none, none, np.empty((0, 4), np.int64)), *parts)))


class _Table:
    """Partials ordered by sensor and time."""

    def __init__(self, rows: _Rows, sensors: np.ndarray, base: int, span: int, longest: int | None):
        place = np.searchsorted(sensors, rows.sensor)
        self.span = span + 1
        keys = place * self.span + (rows.at - base)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.before = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(rows.sums[order], axis=0)])
        # The most rows that one range can cover: those of a sensor, or of a part of its time.
        groups = place if longest is None else place * self.span + (rows.at - base) // longest
        most = int(np.unique(groups, return_counts=True)[1].max(initial=1))
        self.lows = _blocks(np.append(rows.low[order], _HIGH), most, np.minimum)
        self.highs = _blocks(np.append(rows.high[order], _LOW), most, np.maximum)
        self.offsets = np.arange(len(sensors)) * self.span
        self.base = base

    def over(self, start: np.ndarray, end: np.ndarray):
        """Number of rows, lowest, highest and sums over each ``[start, end)`` and sensor."""
        lo = np.searchsorted(self.keys, (start - self.base)[:, None] + self.offsets)
        hi = np.searchsorted(self.keys, (np.maximum(start, end) - self.base)[:, None] + self.offsets)
        rows = hi - lo
        some = rows > 0
        level = np.where(some, np.frexp(rows.astype(np.float64))[1] - 1, 0)
        last = np.where(some, hi - (1 << level), lo)
        low = np.minimum(self.lows[level, lo], self.lows[level, last])
        high = np.maximum(self.highs[level, lo], self.highs[level, last])
        return rows, np.where(some, low, _HIGH), np.where(some, high, _LOW), self.before[hi] - self.before[lo]


def _blocks(values: np.ndarray, most: int, of) -> np.ndarray:
    """Row ``k`` holds the lowest or highest of the ``2**k`` values from each place on."""
    levels = [values]
    for k in range(most.bit_length() - 1):
        wide = levels[-1].copy()
        half = 1 << k
        wide[:-half] = of(wide[:-half], levels[-1][half:])
        levels.append(wide)
    return np.stack(levels)


class _Window:
    """The partials of a window and the next one."""

    def __init__(self, held: list[tuple[int, _Rows]], window: int, shift: int):
        by_kind = [_Rows.joined([rows for kind, rows in held if kind == k]) for k in (SECONDS, MILLISECONDS)]
        self.sensors = np.unique(np.concatenate([rows.sensor for rows in by_kind]))
        base, span = window << shift, 2 << shift
        self.seconds = _Table(by_kind[SECONDS], self.sensors, base, span, None)
        self.milliseconds = _Table(
            by_kind[MILLISECONDS], self.sensors, base * MS_PER_SECOND, span * MS_PER_SECOND, MS_PER_SECOND
        )

    def answers(self, ranges: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(PAIRS_AT_ONCE // len(self.sensors), 1)
        for start in range(0, ranges.num_rows, step):
            answered = self._answer(ranges.slice(start, step))
            if answered.num_rows:
                yield answered

    def _answer(self, ranges: pa.RecordBatch) -> pa.RecordBatch:
        start, end = ranges.column("at").to_numpy(), ranges.column("to_ms").to_numpy() + 1
        first, last = start // MS_PER_SECOND, (end - 1) // MS_PER_SECOND
        edge = np.minimum(end, (first + 1) * MS_PER_SECOND)
        found = [
            self.seconds.over(first + 1, last),
            self.milliseconds.over(start, edge),
            self.milliseconds.over(np.maximum(edge, last * MS_PER_SECOND), end),
        ]
        rows, low, high, sums = zip(*found)
        present = sum(rows) > 0
        low, high = np.minimum.reduce(low)[present], np.maximum.reduce(high)[present]
        sums = sum(sums)[present]
        per_range = present.sum(axis=1)
        empty = sums[:, 3] == 0
        sensor = np.broadcast_to(self.sensors, present.shape)[present]
        parts = pa.StructArray.from_arrays(
            [
                pa.array(np.where(sensor == _NO_SENSOR, 0, sensor), pa.int32(), mask=sensor == _NO_SENSOR),
                pa.array(low, mask=empty),
                pa.array(high, mask=empty),
                _decimals(sums, empty),
                pa.array(sums[:, 3]),
            ],
            ["sensor_type", "min_value", "max_value", "total", "cnt"],
        )
        answered = np.flatnonzero(per_range)
        offsets = np.concatenate([[0], np.cumsum(per_range[answered])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [ranges.column("request_id").take(pa.array(answered)), pa.ListArray.from_arrays(pa.array(offsets), parts)],
            ["request_id", "parts"],
        )


def _decimals(sums: np.ndarray, empty: np.ndarray) -> pa.Array:
    """The limbs of totals put together as 128-bit numbers."""
    middle = sums[:, 1] + (sums[:, 0] >> _LIMB)
    top = sums[:, 2] + (middle >> _LIMB)
    middle &= _MASK
    words = np.empty((len(sums), 2), np.int64)
    words[:, 0] = sums[:, 0] & _MASK | middle << _LIMB
    words[:, 1] = middle >> 64 - _LIMB | top << 8
    valid = pa.array(~empty).buffers()[1]
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(sums), [valid, pa.py_buffer(words)])
