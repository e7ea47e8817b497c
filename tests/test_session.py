"""The shared folder: configured, private for local masters, refused otherwise."""

import pytest

from provisio import session


class Conf:
    def __init__(self, value=None):
        self.value = value

    def get(self, _key, default=None):
        return self.value or default


class Context:
    def __init__(self, master, configured=None):
        self.master, self.configured, self.current = master, configured, None

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path

    def getConf(self):
        return Conf(self.configured)


class Session:
    def __init__(self, master, configured=None):
        self.sparkContext, self.conf = Context(master, configured), Conf(configured)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_configured_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session(master))
    assert session.ensure_checkpoint_dir(Session(master, "hdfs://shared/x")) == "hdfs://shared/x"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_a_local_master_may_go_without(master):
    assert "provisio-ckpt-" in session.ensure_checkpoint_dir(Session(master))
    assert session.scratch_dir(Session(master, "/shared"), "x").startswith("/shared/provisio-x-")


class Remote:
    """A session without a SparkContext."""

    def __init__(self, configured=None):
        self.conf = Conf(configured)

    @property
    def sparkContext(self):
        raise RuntimeError("no context")


def test_a_session_without_context_needs_a_configured_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Remote())
    assert session.scratch_dir(Remote("s3a://shared"), "x").startswith("s3a://shared/provisio-x-")


def test_observed_metrics_come_from_the_rows_written(spark):
    from pyspark.sql import functions as F
    stored, told = session.materialize_observed(spark.range(10).repartition(3), n=F.count(F.lit(1)), ids=F.collect_set("id"))
    assert told["n"] == 10 and sorted(told["ids"]) == list(range(10)) and stored.count() == 10
    empty, told = session.materialize_observed(spark.range(0), ids=F.collect_set("id"))
    assert told["ids"] == [] and empty.count() == 0
