"""Parquet reads and writes of the store's tables."""

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from pulsegrid.operators.hybrid import BLOCK_SECONDS
from pulsegrid.schema import IDS, MESSAGES, QUARANTINE, ROLLUP
from pulsegrid.storage.ids import WRITE_OPTIONS


def _schema(columns: StructType | dict[str, DataType], partitions: dict[str, DataType]) -> StructType:
    if isinstance(columns, dict):
        columns = StructType([StructField(*column) for column in columns.items()])
    return StructType([*columns.fields, *[StructField(*column) for column in partitions.items()]])


_BATCH = {"stream_id": StringType(), "batch_id": LongType()}
_GEN = {"gen": LongType()}

# Table folder -> columns, partition columns last.
TABLES = {
    "messages": _schema(MESSAGES, _BATCH),
    "rollup_1s": _schema(ROLLUP, _BATCH),
    "ids": _schema(IDS, _BATCH),
    "quarantine": _schema(QUARANTINE, _BATCH),
    "commits": _schema(
        {
            "rows": LongType(),
            "min_ts_ms": LongType(),
            "max_ts_ms": LongType(),
            "days": ArrayType(
                StructType(
                    [StructField("event_date", DateType()), StructField("day_rows", LongType())]
                )
            ),
            "quarantined": LongType(),
            "writer": StringType(),
        },
        _BATCH,
    ),
    "sealed_messages": _schema(MESSAGES, _GEN),
    **{f"sealed_rollup_{size}s": _schema(ROLLUP, _GEN) for size in BLOCK_SECONDS},
    "sealed_ids": _schema(IDS, _GEN),
    "seal_coverage": _schema(
        {
            "stream_id": StringType(),
            "from_batch": LongType(),
            "to_batch": LongType(),
            "writer": StringType(),
            "arrived": LongType(),
        },
        _GEN,
    ),
    "seal_days": _schema(
        {
            "event_date": DateType(),
            "data_gen": LongType(),
            "day_rows": LongType(),
            "max_ts_ms": LongType(),
        },
        _GEN,
    ),
    "seals": _schema({"horizon": DateType(), "keep_from": DateType()}, _GEN),
}


def read_folder(spark: SparkSession, path: str, columns: StructType, part: str) -> DataFrame:
    """Parquet folders ``part=N`` below ``path``; empty if there are none yet."""
    schema = StructType([*columns.fields, StructField(part, LongType())])
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, name: str, part: str = "") -> DataFrame:
    """Table ``name``, or the one partition folder ``part`` of it; empty if
    nothing was written yet."""
    reader = spark.read.schema(TABLES[name]).option("basePath", f"{root}/{name}")
    try:
        return reader.parquet(f"{root}/{name}/{part}".rstrip("/"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES[name])


def overwrite(rows: DataFrame, root: str, name: str, part: str, by_day: bool = False) -> None:
    """Write one partition folder, replacing what an earlier attempt left there."""
    # A session default of "dynamic" would keep days the earlier attempt wrote.
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if by_day:
        writer = writer.partitionBy("event_date")
    if name in ("ids", "sealed_ids"):
        writer = writer.options(**WRITE_OPTIONS)
    writer.parquet(f"{root}/{name}/{part}")


class Folders:
    """Folders below ``root`` on whatever file system it is on."""

    def __init__(self, spark: SparkSession, root: str, before: datetime):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root = root
        self._files = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._before = before.timestamp() * 1000

    def _at(self, folder: str):
        return self._path(f"{self._root}/{folder}")

    def children(self, folder: str) -> list[str]:
        """Names of partition folders."""
        if not self._files.exists(self._at(folder)):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._at(folder))]
        return [name for name in names if "=" in name and not name.startswith((".", "_"))]

    def is_old(self, folder: str) -> bool:
        """Whether the folder is there and was last changed before the given time."""
        at = self._at(folder)
        return self._files.exists(at) and self._files.getFileStatus(at).getModificationTime() < self._before

    def delete(self, folder: str) -> bool:
        return self._files.delete(self._at(folder), True)
