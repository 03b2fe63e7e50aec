"""Answers that combine two tables: rollup with raw edges, hot with cold."""

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.timeaxis import MS_PER_SECOND
from pulsegrid.operators.filters import closed_range, date_range, within
from pulsegrid.operators.synthesis import partials, spread_partials, synthesis_of, union_all
from pulsegrid.schema import PARTIAL_VALUES


# Seconds of a block of each rollup level; each size divides the next one.
BLOCK_SECONDS = (1, 60, 3_600, 86_400)


def edge_partials(messages: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Partials by sensor over the first and the last second of ``[from_ms, to_ms]``, one
    read if they are the same."""
    first, last = from_ms // MS_PER_SECOND, to_ms // MS_PER_SECOND
    edges = messages.filter(
        F.col("bucket").isin(sorted({first, last})) & closed_range(from_ms, to_ms)
    )
    return partials(edges, "sensor_type")


def fewest_blocks(from_ms: int, to_ms: int) -> dict[int, list[tuple[int, int]]]:
    """The seconds wholly inside ``[from_ms, to_ms]`` as the fewest aligned blocks: for each
    block size the ranges of seconds that blocks of it fill, both ends of a range aligned."""
    lo, hi = from_ms // MS_PER_SECOND + 1, to_ms // MS_PER_SECOND
    found: dict[int, list[tuple[int, int]]] = {}
    for size, coarser in zip(BLOCK_SECONDS, (*BLOCK_SECONDS[1:], None), strict=True):
        start, end = (-(-lo // coarser) * coarser, hi // coarser * coarser) if coarser else (hi, hi)
        if start >= end:
            start = end = hi
        ranges = [(a, b) for a, b in ((lo, start), (end, hi)) if a < b]
        if ranges:
            found[size] = ranges
        lo, hi = start, end
        if lo >= hi:
            break
    return found


def in_ranges(rollup: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Partials by sensor of the blocks that begin in one of ``ranges``; days and bounds
    reach the scan."""
    bucket, wanted = F.col("bucket"), F.lit(False)
    for start, end in ranges:
        days = date_range(start * MS_PER_SECOND, end * MS_PER_SECOND - 1)
        wanted = wanted | (days & (bucket >= start) & (bucket < end))
    return rollup.filter(wanted).select("sensor_type", *PARTIAL_VALUES)


def hybrid_partials(messages: DataFrame, rollup: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Partials by sensor over ``[from_ms, to_ms]``.

    Seconds that lie wholly inside come from ``rollup``; only the first and the
    last second are read from ``messages``. Both sides carry pushable ``event_date``
    and ``bucket`` bounds.
    """
    first, last = from_ms // MS_PER_SECOND, to_ms // MS_PER_SECOND
    inside = in_ranges(rollup, [(first + 1, last)] if first + 1 < last else [])
    return edge_partials(messages, from_ms, to_ms).unionByName(inside)


def hybrid_synthesis(messages: DataFrame, rollup: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return synthesis_of(hybrid_partials(messages, rollup, from_ms, to_ms))


def hot_cold_partials(hot: DataFrame, cold: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Partials over two disjoint message tables, each aggregated on its own."""
    sides = [spread_partials(within(side, from_ms, to_ms), "sensor_type") for side in (hot, cold)]
    return union_all(*sides)


def hot_cold_synthesis(hot: DataFrame, cold: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return synthesis_of(hot_cold_partials(hot, cold, from_ms, to_ms))
