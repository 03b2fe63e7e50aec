"""The index of stored ids.

A table of ids, each with a bucket (a hash of the id) and the day of its message, written
with every batch and compacted when its days are sealed. Files are sorted by bucket and id
and carry Parquet's Bloom filters on the id. A probe names the buckets its ids fall into,
so that only files and row groups of these are read; a handful of ids is looked up by value,
where the Bloom filters tell which row groups need not be opened at all.
"""

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.joins import probe

# Buckets; fixed for the life of a store.
BUCKETS = 256
# Probes of so few different ids are looked up by value.
FEW_IDS = 10

COLUMNS = ["id", "id_bucket", "event_date"]

# Row groups are small, so that a Bloom filter and the bounds of the buckets skip much.
WRITE_OPTIONS = {"parquet.bloom.filter.enabled#id": "true", "parquet.block.size": str(8 << 20)}


def bucket_of_id() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def indexed(messages: DataFrame) -> DataFrame:
    """The index rows of ``messages``; a message without id has none."""
    return messages.where(F.col("id").isNotNull()).select("id", bucket_of_id().alias("id_bucket"), "event_date")


class Ids:
    """Lookups in index rows (``id, id_bucket``)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def matching(self, probes: DataFrame) -> DataFrame:
        """The stored ids that can match ``id`` of ``probes``: those of its buckets.

        Two small jobs: the list of buckets, no longer than BUCKETS, and up to FEW_IDS ids.
        """
        asked = probes.where(F.col("id").isNotNull()).select("id")
        buckets = sorted(row["b"] for row in asked.select(bucket_of_id().alias("b")).distinct().collect())
        rows = self.rows
        if len(buckets) < BUCKETS:
            rows = rows.where(F.col("id_bucket").isin(buckets))
        if len(buckets) <= FEW_IDS:
            few = [row["id"] for row in asked.distinct().limit(FEW_IDS + 1).collect()]
            if len(few) <= FEW_IDS:
                rows = rows.where(F.col("id").isin(few))
        return rows.select("id")

    def known(self, probes: DataFrame) -> DataFrame:
        """Rows of ``probes`` whose id is stored."""
        return probe(probes, self.matching(probes), ["id"], "left_semi")

    def unknown(self, probes: DataFrame) -> DataFrame:
        """Rows of ``probes`` whose id is not stored, or null."""
        return probe(probes, self.matching(probes), ["id"], "left_anti")
