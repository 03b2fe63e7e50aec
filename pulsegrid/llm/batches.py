"""Arrow batches of bounded size, and what the operators share around them."""

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import prepare

#: Documents per Arrow batch, and bytes: a task holds one batch at a time, however long the texts.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

#: Rows up to which ``small`` marks a table for broadcast.
BROADCAST_ROWS = 500_000

Batches = Iterator[pa.RecordBatch]


@cache
def _package(application: str) -> str:
    """A zip of this library for the executors of an application."""
    top = Path(__file__).resolve().parents[2]
    path = f"{tempfile.mkdtemp(prefix='pulsegrid-package-')}/pulsegrid_package.zip"
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted((top / "pulsegrid").rglob("*.py")):
            file.write(source, source.relative_to(top))
    return path


@cache
def _ship(application: str) -> None:
    from pyspark import SparkContext

    SparkContext.getOrCreate().addPyFile(_package(application))


def map_batches(df: DataFrame, task: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df`` through ``task``, batch by batch, within each partition.

    Python workers wait for further tasks with what they once allocated; when a task ends,
    what it has freed goes back to the system.
    """
    spark = prepare(df.sparkSession)
    _ship(spark.sparkContext.applicationId)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)

    def run(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        gc.set_threshold(100_000, 20, 20)  # tasks hold many small objects and few cycles
        yield from task(batches)
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return df.mapInArrow(run, schema)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, as ``doc_id`` and ``text``; a null text is empty.

    Other columns are left behind, whatever their names.
    """
    return df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """``df`` of a few short columns, marked for broadcast when it has few enough rows;
    beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
