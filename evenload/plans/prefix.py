"""Running totals over a global order without sending all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenload.scratch import materialize, shuffle_partitions


def running_total(df: DataFrame, order: Sequence[str], amount: str, total: str = "cum", descending: bool = False) -> DataFrame:
    """Adds the inclusive running sum of amount in the given order, and grand, the sum of all.

    Rows are range-partitioned; one total per range gives the offsets.
    """
    sort = [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in order]
    ranged = materialize(
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *sort).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    direction = "desc nulls last" if descending else "asc nulls first"
    by = ", ".join(f"`{c}` {direction}" for c in order)
    # A row per range.
    offsets = (
        ranged.groupBy("_range")
        .agg(F.sum(amount).alias("_sum"))
        .withColumn("_before", F.expr("sum(_sum) over (order by _range) - _sum"))
        .withColumn("grand", F.expr("sum(_sum) over ()"))
        .drop("_sum")
    )
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(total, F.expr(f"_before + sum({amount}) over (partition by _range order by {by} rows unbounded preceding)"))
        .drop("_range", "_before")
    )
