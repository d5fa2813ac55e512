"""Shared scratch storage: where lineage is cut and slim intermediates are kept.

Everything is written under ``spark.checkpoint.dir``, which every executor and
the driver can reach, so a lost executor never loses an intermediate.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a local one only for a local master that names none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="evenload-"))
    return sc.getCheckpointDir().rstrip("/")


#: In force while an intermediate is written: its shuffle files go when it is in the
#: shared folder, and rows with long texts reach Python in small batches.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The files go when discarded, or when the application ends. Column order and types are kept.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/evenload/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._evenload_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a materialised DataFrame that nothing reads any more."""
    path = getattr(df, "_evenload_path", None)
    if path:
        where, files = _files(df.sparkSession, path)
        files.delete(where, True)


def _files(spark: SparkSession, path: str):
    """The path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
