"""Where cut points go."""

import pytest

from folio_spark import session


class Context:
    def __init__(self, master, app):
        self.master, self.applicationId = master, app


class Session:
    def __init__(self, master, app, path=None):
        self.sparkContext, self.conf = Context(master, app), {"spark.checkpoint.dir": path} if path else {}


def test_shared_dir():
    assert session.shared_dir(Session("yarn", "a", "hdfs:///cuts")) == "hdfs:///cuts"
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("yarn", "a"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("local[2]", "b"))


def test_local_folder_is_for_local_sessions_without_the_setting():
    for master, app in (("local[2]", "c"), ("local[2]", "d"), ("yarn", "e"), ("local-cluster[2,1,1024]", "f")):
        session.use_local_folder(Session(master, app))
    local = session.shared_dir(Session("local[2]", "c"))
    session.use_local_folder(Session("local[2]", "c"))
    assert local == session.shared_dir(Session("local[2]", "c")) != session.shared_dir(Session("local[2]", "d"))
    for master, app in (("yarn", "e"), ("local-cluster[2,1,1024]", "f")):
        with pytest.raises(RuntimeError):
            session.shared_dir(Session(master, app))
    session.use_local_folder(Session("local[2]", "g", "file:///cuts"))
    assert session.shared_dir(Session("local[2]", "g", "file:///cuts")) == "file:///cuts"


def test_durable_keeps_rows_and_cuts_lineage(spark):
    df = session.durable(spark.range(5).selectExpr("id * 2 as x"))
    assert sorted(r.x for r in df.collect()) == [0, 2, 4, 6, 8]
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString().replace("RangePartitioning", "")
