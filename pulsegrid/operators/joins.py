"""Join sides whose size is checked before they are broadcast."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
MAX_HEAVY_KEYS = 10_000


class Size(NamedTuple):
    rows: int
    bytes: int

    @property
    def fits_broadcast(self) -> bool:
        return self.rows <= MAX_BROADCAST_ROWS and self.bytes <= MAX_BROADCAST_BYTES


def measure(keys: DataFrame) -> Size:
    """Size of a key table, by a distributed aggregate that returns one row."""
    width = F.lit(0).cast("bigint")
    for name, dtype in keys.dtypes:
        width += F.coalesce(F.octet_length(name), F.lit(0)) if dtype == "string" else F.lit(8)
    return Size(*keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first())


def keys_fit_broadcast(keys: DataFrame) -> bool:
    return measure(keys).fits_broadcast


def semi_join(big: DataFrame, keys: DataFrame, on: list[str], *, small: bool) -> DataFrame:
    """Rows of ``big`` whose key occurs in ``keys``.

    ``small`` says the caller has checked the size of ``keys``: they are then
    broadcast and ``big`` stays where it is. Otherwise both sides are shuffled,
    and adaptive execution splits the partitions of hot keys.
    """
    return big.join(F.broadcast(keys) if small else keys.hint("merge"), on, "left_semi")


def probe(probes: DataFrame, store: DataFrame, on: list[str], how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of ``probes`` with the keys of ``store``.

    A probe batch that fits is broadcast into the scan of the store, so the store
    is not shuffled; the keys found there are no more than the probes and are
    broadcast back. A larger batch meets the store's distinct keys in a shuffle.
    """
    wanted, stored = probes.select(*on), store.select(*on)
    size = measure(wanted)
    if size.fits_broadcast:
        found = semi_join(stored, wanted, on, small=True).distinct()
        return probes.join(F.broadcast(found), on, how)
    # A key with more than 1/MAX_HEAVY_KEYS of the probes would make one task slow.
    # There are fewer than MAX_HEAVY_KEYS such keys, so they are broadcast.
    often = F.count(F.lit(1)) > size.rows // MAX_HEAVY_KEYS
    heavy = wanted.groupBy(*on).agg(often.alias("_often")).filter("_often").select(*on)
    heavy_found = semi_join(stored, heavy, on, small=True).distinct()
    by_broadcast = semi_join(probes, heavy, on, small=True).join(F.broadcast(heavy_found), on, how)
    rest = probes.join(F.broadcast(heavy), on, "left_anti")
    return by_broadcast.unionByName(rest.join(stored.distinct().hint("merge"), on, how))
