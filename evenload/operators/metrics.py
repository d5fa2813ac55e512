"""How evenly rows lie over partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def every_partition(spark: SparkSession, partitions: int) -> DataFrame:
    """(pid): all of them."""
    return spark.range(partitions).select(F.col("id").cast("int").alias("pid"))


def balance(df: DataFrame, partitions: int, keys: Sequence[str] = (), pid: Column | str | None = None) -> DataFrame:
    """(pid, rows, keys): rows and distinct keys of each partition, empty ones included.

    pid defaults to the physical partition, so df must come straight from its exchange.
    """
    at = (F.spark_partition_id() if pid is None else F.col(pid) if isinstance(pid, str) else pid).cast("int")
    marked = df.withColumn("_pid", at)
    if keys:
        per_key = marked.groupBy("_pid", *keys).agg(F.count("*").alias("_n"))
        counted = per_key.groupBy(F.col("_pid").alias("pid")).agg(F.sum("_n").alias("rows"), F.count("*").alias("keys"))
    else:
        counted = marked.groupBy(F.col("_pid").alias("pid")).agg(F.count("*").alias("rows"), F.lit(None).cast("long").alias("keys"))
    return every_partition(df.sparkSession, partitions).join(counted, "pid", "left").select(
        "pid", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("keys", F.lit(0)).cast("long").alias("keys")
    )


def bytes_of(df: DataFrame, partitions: int, pid: str = "pid") -> DataFrame:
    """(pid, rows, bytes): estimated bytes of each partition, strings by length and other values at 8 bytes."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        if name != pid:
            size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    counted = df.groupBy(pid).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    return every_partition(df.sparkSession, partitions).join(counted.withColumnRenamed(pid, "pid"), "pid", "left").select(
        "pid", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    )


def fos(loads: DataFrame, column: str = "rows") -> DataFrame:
    """(fos): the population standard deviation of the loads over their mean."""
    return loads.agg((F.stddev_pop(column) / F.avg(column)).alias("fos"))


def max_over_mean(loads: DataFrame, column: str = "rows") -> DataFrame:
    """(peak): the largest load over the mean."""
    return loads.agg((F.max(column) / F.avg(column)).alias("peak"))


def accumulated(balances: Sequence[DataFrame]) -> DataFrame:
    """(pid, rows): rows of each partition summed over several exchanges."""
    return reduce(lambda a, b: a.unionByName(b), [b.select("pid", "rows") for b in balances]).groupBy("pid").agg(F.sum("rows").alias("rows"))


def exchanges(df: DataFrame) -> int:
    """The exchanges in a DataFrame's physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(" Exchange " in f" {line.lstrip(' :+-*()0123456789')} " for line in plan.splitlines())
