"""Scratch storage and shipping."""

import pytest
from pyspark.sql import functions as F

from evenload import scratch, shipping


def test_materialize_keeps_rows_and_types(spark):
    df = spark.range(10).select("id", F.struct("id", F.lit("x").alias("s")).alias("t"), F.array("id").alias("a"), F.lit(None).cast("string").alias("n"))
    out = scratch.materialize(df)
    assert out.dtypes == df.dtypes and sorted(out.collect()) == sorted(df.collect())
    assert all(f.startswith("file:") and "/evenload/" in f for f in out.inputFiles())
    assert scratch.materialize(df.limit(0)).count() == 0


class Session:
    """As much of a cluster's session as scratch_root reads."""

    def __init__(self, folder):
        self.sparkContext = self
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.master = "spark://somewhere:7077"

    def getConf(self):  # noqa: N802
        return {}

    def getCheckpointDir(self):  # noqa: N802
        return None


def test_the_session_names_the_folder():
    assert scratch.scratch_root(Session("hdfs://shared/x/")) == "hdfs://shared/x"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError):
        scratch.scratch_root(Session(None))


def test_ship_once(spark):
    shipping.ship(spark)
    shipping.ship(spark)
    files = [str(x) for x in spark.sparkContext._jsc.sc().listFiles().mkString("\n").split("\n")]
    assert sum("evenload_package" in f for f in files) == 1
