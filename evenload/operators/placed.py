"""Joins and aggregations whose rows sit where a plan puts them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenload.config import PlanConfig
from evenload.functions.cost import COST_OF_JOIN
from evenload.plans.placement import choose, place


def placed_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", cfg: PlanConfig | None = None,
    null_safe: bool = False, input_only: bool = False,
) -> DataFrame:
    """left joined to right on keys, with both sides placed by one plan; the result has pid.

    how: inner, left, right, full or left_anti (rows of left without a match,
    repeated rows kept). null_safe: null keys match. input_only: the plan counts
    rows read, not rows emitted. Keys that both sides hold appear once.
    """
    cfg = cfg or PlanConfig()
    optype = COST_OF_JOIN[how]
    if input_only:
        optype = "joinnull"
    plan = choose(cfg, left, right, keys, optype)
    l = place(left, keys, plan, cfg.partitions)
    if how == "left_anti":
        # As a left join to flagged distinct keys: an anti join would be pushed below the exchange.
        flagged = right.select(*keys).distinct()
        r = place(flagged, keys, plan, cfg.partitions).withColumn("_hit", F.lit(True))
        return _matched(l, r, keys, "left", null_safe).where("_hit is null").select("pid", *left.columns)
    r = place(right, keys, plan, cfg.partitions)
    return _matched(l, r, keys, how, null_safe)


def _matched(l: DataFrame, r: DataFrame, keys: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    on = ["pid", *keys]
    hinted = r.hint("merge")  # broadcasting would undo the placement
    if not null_safe:
        return l.join(hinted, on, how)
    renamed = hinted.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in r.columns])
    same = reduce(lambda a, b: a & b, [(F.col("pid") == F.col("_r_pid")), *(F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)])
    joined = l.join(renamed.hint("merge"), same, how)
    merged = [F.coalesce(c, f"_r_{c}").alias(c) for c in on]
    return joined.select(*merged, *[c for c in l.columns if c not in on], *[c for c in r.columns if c not in on])


def placed_aggregate(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], optype: str = "combine", cfg: PlanConfig | None = None
) -> DataFrame:
    """df grouped by keys where a plan puts them: no exchange besides the placement; the result has pid."""
    cfg = cfg or PlanConfig()
    plan = choose(cfg, df, None, keys, optype)
    return place(df, keys, plan, cfg.partitions).groupBy("pid", *keys).agg(*aggregates)


def combined_locally(df: DataFrame, keys: Sequence[str], reducers: dict[str, str]) -> DataFrame:
    """Rows of equal keys merged within each input partition: at most one of a key leaves it.

    reducers: column -> sum, min or max.
    """
    parts = df.select(*keys, *reducers).withColumn("_part", F.spark_partition_id())
    return parts.groupBy("_part", *keys).agg(*[getattr(F, r)(c).alias(c) for c, r in reducers.items()]).drop("_part")


def reduce_by_key(df: DataFrame, keys: Sequence[str], reducers: dict[str, str], cfg: PlanConfig | None = None) -> DataFrame:
    """(pid, keys, reduced columns): merged in each input partition first, then placed and merged.

    reducers: column -> sum, min or max. The plan counts merged rows: one of a key from each input partition.
    """
    cfg = cfg or PlanConfig()
    final = [getattr(F, r)(c).alias(c) for c, r in reducers.items()]
    plan = choose(cfg, df, None, keys, "reduceByKey", combined=True)
    sent = place(combined_locally(df, keys, reducers), keys, plan, cfg.partitions)
    return sent.groupBy("pid", *keys).agg(*final)


def group_by_key(df: DataFrame, keys: Sequence[str], value: str, cfg: PlanConfig | None = None) -> DataFrame:
    """(pid, keys, values): each key's values, sorted."""
    return placed_aggregate(df, keys, [F.sort_array(F.collect_list(value)).alias("values")], "groupByKey", cfg)


def combine_by_key(df: DataFrame, keys: Sequence[str], value: str, zero: Column, merge, finish, cfg: PlanConfig | None = None) -> DataFrame:
    """(pid, keys, result): any fold of a key's sorted values, as expressions."""
    folded = F.aggregate(F.sort_array(F.collect_list(value)), zero, merge, finish)
    return placed_aggregate(df, keys, [folded.alias("result")], "combine", cfg)


def ordered_sum(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value): each key's values added one by one in an order that has no ties.

    Sums of doubles depend on the order of their terms; these do not depend on how rows lie. So nothing
    is merged before the exchange, and a key's rows are streamed by one task.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = df.select(*keys, F.sum(value).over(whole).alias(value), F.row_number().over(by).alias("_nth"))
    return summed.where("_nth = 1").drop("_nth")


def subtract_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], cfg: PlanConfig | None = None) -> DataFrame:
    """Rows of left whose key right does not have."""
    return placed_join(left, right, keys, "left_anti", cfg)
