import types

import pytest

from siftline import tables


def session(master, folder=None):
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda name, default: folder or default), sparkContext=types.SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_written_tables_go_to_the_shared_folder():
    assert tables.shared_dir(session("spark://host:7077", "hdfs://host/x/")) == "hdfs://host/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(session("spark://host:7077"))


def test_a_local_session_keeps_one_folder():
    local = session("local[2]")
    first = tables.shared_dir(local)
    assert first.startswith("file://") and tables.shared_dir(local) == first and tables.new_path(local, "a").startswith(first + "/siftline/a-")


def test_small_sides_are_counted(spark, monkeypatch):
    df = spark.range(10)
    plan = lambda x: spark.range(5).join(x, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(tables.small_side(df))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 5)
    assert "broadcast" not in plan(tables.small_side(df))
