import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.functions.timeaxis import with_time_columns
from pulsegrid.schema import message_columns
from pulsegrid.session import prepare


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("pulsegrid-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def messages_of(spark):
    """``[(ts_ms, sensor, value), ...]`` as a message table."""

    def build(rows):
        numbered = [(str(n), ts, n, sensor, value) for n, (ts, sensor, value) in enumerate(rows)]
        schema = "id STRING, ts_ms BIGINT, seq BIGINT, sensor_type INT, value BIGINT"
        return with_time_columns(spark.createDataFrame(numbered, schema)).select(*message_columns())

    return build


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(row) for row in df.collect())
