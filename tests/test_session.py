import pytest

from pulsegrid import session


class _Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    """Stands for a session with given settings; a running one cannot change them."""

    def __init__(self, master, **values):
        self.conf = _Conf(**values)
        self.sparkContext = type("Context", (), {"master": master})


def test_the_named_folder_is_used(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    named = _Session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert session.shared_folder(named) == "hdfs:///shared"


def test_only_a_local_session_may_name_none():
    folder = session.shared_folder(_Session("local[2]"))
    assert session.shared_folder(_Session("local[2]")) == folder
    with pytest.raises(ValueError):
        session.shared_folder(_Session("spark://host:7077"))


def test_workspaces_differ(spark):
    assert session.workspace(spark, "x") != session.workspace(spark, "x")


def test_written_tables_read_back(spark):
    df = spark.range(5)
    back = session.written(df, "test-written")
    assert back.schema.fieldNames() == ["id"] and back.count() == 5
