"""Placements: which partition a row goes to, and sending it there.

A plan that moves keys is a table (keys, pid); all other keys keep the bucket that
hashing gives them. Such plans are bounded by PlanConfig.planned_keys, which is why
they may be broadcast. A plan by ranges is Bounds: the first keys of the ranges after
the first, which rows are compared with where they lie, so they are exchanged once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenload.config import PlanConfig
from evenload.functions.cost import JOIN_TYPES, key_weight
from evenload.operators.sampling import estimated_rows
from evenload.plans import planners
from evenload.plans.prefix import running_total
from evenload.scratch import materialize


log = logging.getLogger(__name__)


def hash_bucket(df: DataFrame, keys: Sequence[str], partitions: int) -> Column:
    """The bucket of a key; null keys go to 0.

    One integer key goes by its 64-bit value folded to 32 bits, so small keys go
    by their remainder; other keys by xxhash64 (arrays by their values).
    """
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        v = F.col(keys[0]).cast("long")
        low = v.bitwiseXOR(F.shiftrightunsigned(v, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        folded = F.when(low >= 2**31, low - 2**32).otherwise(low)
        return F.coalesce(F.pmod(folded, F.lit(partitions)), F.lit(0)).cast("int")
    null = reduce(lambda a, b: a & b, [F.col(k).isNull() for k in keys])
    return F.when(null, 0).otherwise(F.pmod(F.xxhash64(*keys), F.lit(partitions))).cast("int")


def decided(value: Column, bounds: Sequence, leaf: Callable[[int], Column], greater: Callable[[Column, object], Column]) -> Column:
    """leaf(i) for the number i of bounds that are not greater than value: a binary search, as an expression."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return leaf(low)
        mid = (low + high) // 2
        return F.when(greater(value, bounds[mid]), between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(bounds))


@dataclass(frozen=True)
class Bounds:
    """Ranges of keys: bounds holds the first keys of the second and later ranges, pids each range's partition."""

    keys: tuple[str, ...]
    types: tuple[T.DataType, ...]
    bounds: tuple[tuple, ...]
    pids: tuple[int, ...]

    def pid(self) -> Column:
        """The partition of a row, by its keys; nulls come before all values."""

        def literal(bound: tuple) -> Column:
            return F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(self.keys, bound, self.types, strict=True)])

        own = F.struct(*[F.col(k).cast(t).alias(k) for k, t in zip(self.keys, self.types, strict=True)])
        return decided(own, self.bounds, lambda i: F.lit(self.pids[i]), lambda v, b: v < literal(b)).cast("int")


def bounds_of(placed: DataFrame, keys: Sequence[str]) -> Bounds:
    """The bounds of rows (keys, pid), one per key, whose pid rises with the keys: a row per partition reaches the driver."""
    first = placed.groupBy("pid").agg(F.min(F.struct(*keys)).alias("first")).orderBy("pid").collect()
    types = tuple(placed.schema[k].dataType for k in keys)
    return Bounds(tuple(keys), types, tuple(tuple(r["first"]) for r in first[1:]), tuple(r.pid for r in first) or (0,))


def key_loads(
    left: DataFrame, right: DataFrame | None, keys: Sequence[str], optype: str, cfg: PlanConfig, assume_symmetric: bool = False,
    combined: bool = False,
) -> DataFrame:
    """(keys, v1, v2, weight, bucket): estimated rows of each key, its load, and its hash bucket."""
    sides = [estimated_rows(left, keys, cfg, combined).select(*keys, F.col("v").alias("v1"), F.lit(0.0).alias("v2"))]
    if right is not None:
        sides.append(estimated_rows(right, keys, cfg, combined).select(*keys, F.lit(0.0).alias("v1"), F.col("v").alias("v2")))
    both = reduce(lambda a, b: a.unionByName(b), sides)
    if right is not None:
        both = both.groupBy(*keys).agg(F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
    two = optype in JOIN_TYPES
    weight = key_weight(optype, F.col("v1"), F.col("v2") if two and right is not None else None, assume_symmetric)
    return both.withColumn("weight", weight).withColumn("bucket", hash_bucket(both, keys, cfg.partitions))


def bucket_loads(loads: DataFrame, partitions: int) -> DataFrame:
    """(pid, load): the summed weight of each hash bucket, empty ones included."""
    every = loads.sparkSession.range(partitions).select(F.col("id").cast("int").alias("pid"))
    summed = loads.groupBy(F.col("bucket").alias("pid")).agg(F.sum("weight").alias("load"))
    return every.join(summed, "pid", "left").select("pid", F.coalesce("load", F.lit(0.0)).alias("load"))


def _frozen(value: object) -> object:
    """A key value that can be compared and hashed: lists become tuples."""
    return tuple(_frozen(v) for v in value) if isinstance(value, (list, tuple)) else value


def collected(loads: DataFrame, keys: Sequence[str], cfg: PlanConfig) -> tuple[list[planners.KeyLoad], list[float]]:
    """The heaviest keys of overloaded buckets, a bounded number, and per bucket the load of all other keys.

    Without an overloaded bucket no key is listed, which is all a planner needs to move none.
    Keys beyond the bound keep their bucket; how much load that is goes to the log.
    """
    fixed = [0.0] * cfg.partitions
    for r in loads.groupBy("bucket").agg(F.sum("weight").alias("load")).collect():
        fixed[r.bucket] = r.load
    bound = cfg.tolerance * sum(fixed) / cfg.partitions
    crowded = [b for b, load in enumerate(fixed) if load > bound]
    if not crowded:
        return [], fixed
    movable = loads.where(F.col("bucket").isin(crowded)).dropna(subset=list(keys))  # null keys always stay in bucket 0
    top = movable.orderBy(F.desc("weight"), *keys).limit(cfg.planned_keys).collect()
    listed = [planners.KeyLoad(tuple(_frozen(r[k]) for k in keys), r.weight, r.bucket) for r in top]
    for k in listed:
        fixed[k.bucket] -= k.weight
    over = sum(max(0.0, fixed[b] - bound) for b in crowded)
    if len(top) == cfg.planned_keys and over > 0:
        log.warning("overloaded buckets hold more than %d keys: a load of %.0f beyond the bound stays", cfg.planned_keys, over)
    return listed, [max(0.0, x) for x in fixed]


def moved_keys(loads: DataFrame, keys: Sequence[str], cfg: PlanConfig) -> dict:
    """Moved keys and their partition, by a planner that moves whole keys."""
    planner = {"first_fit": planners.first_fit, "best_fit": planners.best_fit}.get(cfg.strategy)
    if planner is None:
        raise ValueError(f"{cfg.strategy} does not move whole keys")
    listed, fixed = collected(loads, keys, cfg)
    return planner(listed, cfg.partitions, cfg.tolerance, fixed)


Plan = DataFrame | Bounds


def make_plan(loads: DataFrame, keys: Sequence[str], cfg: PlanConfig) -> Plan:
    """The moved keys (keys, pid) or the ranges under cfg.strategy; no key for hash."""
    if cfg.strategy in ("minmax", "range"):
        return bounds_of({"minmax": minmax_plan, "range": range_plan}[cfg.strategy](loads, keys, cfg), keys)
    return _plan_of({} if cfg.strategy == "hash" else moved_keys(loads, keys, cfg), loads, keys)


def _plan_of(moved: dict, loads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moved keys as a table."""
    schema = T.StructType([*(loads.schema[k] for k in keys), T.StructField("pid", T.IntegerType())])
    return loads.sparkSession.createDataFrame([(*k, p) for k, p in moved.items()], schema)


def minmax_plan(loads: DataFrame, keys: Sequence[str], cfg: PlanConfig) -> DataFrame:
    """(keys, pid): every key, in contiguous segments of the key order whose largest load is least.

    The driver sees runs of neighbouring keys, whose running totals share one of
    planned_keys equal steps. A key heavier than a step is a run of its own, and cuts
    are exact to a step at any size.
    """
    cum = running_total(loads.select(*keys, "weight"), keys, "weight")
    step = F.floor(F.col("cum") / F.nullif("grand", F.lit(0.0)) * F.lit(cfg.planned_keys))
    spread = cum.withColumn("_run", F.coalesce(step, F.lit(0)).cast("long"))
    runs = spread.groupBy("_run").agg(F.sum("weight").alias("w")).orderBy("_run").collect()  # at most planned_keys + 1
    cuts = planners.minmax_cuts([r.w for r in runs], cfg.partitions)
    pid = decided(F.col("_run"), [runs[c]._run + 1 for c in cuts], F.lit, lambda v, b: v < F.lit(b))
    return spread.select(*keys, pid.cast("int").alias("pid"))


def range_plan(loads: DataFrame, keys: Sequence[str], cfg: PlanConfig) -> DataFrame:
    """(keys, pid): every key, in ranges of about equal load; a key goes where its stretch begins."""
    cum = running_total(loads.select(*keys, "weight"), keys, "weight")
    pid = F.floor((F.col("cum") - F.col("weight")) * F.lit(cfg.partitions) / F.nullif("grand", F.lit(0.0)))
    return cum.select(*keys, F.coalesce(F.least(F.lit(cfg.partitions - 1), pid), F.lit(0)).cast("int").alias("pid"))


def with_pid(df: DataFrame, keys: Sequence[str], plan: Plan | None, partitions: int) -> DataFrame:
    """df with pid: the plan's partition of a key, else its hash bucket."""
    if isinstance(plan, Bounds):
        return df.withColumn("pid", plan.pid())
    bucket = hash_bucket(df, keys, partitions)
    if plan is None:
        return df.withColumn("pid", bucket)
    names = [f"_plan_{i}" for i in range(len(keys))]
    renamed = plan.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("pid").alias("_pid"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    joined = df.join(F.broadcast(renamed), match, "left")  # at most planned_keys rows
    return joined.select(*df.columns, F.coalesce("_pid", bucket).alias("pid"))


def place(df: DataFrame, keys: Sequence[str], plan: Plan | None, partitions: int) -> DataFrame:
    """df sent to partition pid of so many."""
    return with_pid(df, keys, plan, partitions).repartitionById(partitions, F.col("pid"))


def range_place(df: DataFrame, keys: Sequence[str], partitions: int, descending: bool = False) -> DataFrame:
    """df by ranges of its keys; equal keys stay together."""
    return df.repartitionByRange(partitions, *[F.desc(k) if descending else F.asc(k) for k in keys])


# Splitting heavy keys over neighbouring ranges (for sorts only: equal keys part).


def split_range(weights: DataFrame, key: str, partitions: int, weight: str = "weight", descending: bool = False) -> DataFrame:
    """(key, weight, prev, cum, step): where each key's weight lies in the running total, and a range's share."""
    cum = running_total(weights.select(key, F.col(weight).cast("double").alias("weight")), [key], "weight", descending=descending)
    return cum.select(
        key, "weight", (F.col("cum") - F.col("weight")).alias("prev"), "cum", (F.col("grand") / F.lit(partitions)).alias("step")
    )


def split_bounds(split: DataFrame, key: str, partitions: int) -> DataFrame:
    """(j, bound_key, ratio): the key in which bound j falls, and the share of its rest that lies before."""
    first, last = F.floor(F.col("prev") / F.col("step")) + 1, F.floor(F.col("cum") / F.col("step"))
    bounds = split.where((F.col("weight") > 0) & (first <= F.least(last, F.lit(partitions - 1)))).withColumn(
        "j", F.explode(F.sequence(first, F.least(last, F.lit(partitions - 1))))
    )
    start = F.greatest(F.col("prev"), (F.col("j") - 1) * F.col("step"))
    ratio = (F.col("j") * F.col("step") - start) / (F.col("cum") - start)
    return bounds.select(F.col("j").cast("int").alias("j"), F.col(key).alias("bound_key"), ratio.alias("ratio"))


def split_shares(split: DataFrame, key: str, partitions: int) -> DataFrame:
    """(pid, key, load): how much of each key every partition gets."""
    low = F.least(F.lit(partitions - 1), F.floor(F.col("prev") / F.col("step")))
    high = F.least(F.lit(partitions - 1), F.ceil(F.col("cum") / F.col("step")) - 1)
    cut = split.where("weight > 0").withColumn("pid", F.explode(F.sequence(low, F.greatest(low, high))))
    load = F.least(F.col("cum"), (F.col("pid") + 1) * F.col("step")) - F.greatest(F.col("prev"), F.col("pid") * F.col("step"))
    return cut.select(F.col("pid").cast("int").alias("pid"), key, load.alias("load"))


class Stretch(NamedTuple):
    """A key in which bounds fall, the weight before it and through it, and a range's share."""

    key: object
    prev: float
    cum: float
    step: float


def cut_keys(split: DataFrame, key: str, partitions: int) -> list[Stretch]:
    """The keys in which bounds fall, fewer than partitions."""
    first, last = F.floor(F.col("prev") / F.col("step")) + 1, F.floor(F.col("cum") / F.col("step"))
    held = split.where((F.col("weight") > 0) & (first <= F.least(last, F.lit(partitions - 1)))).orderBy("prev")
    return [Stretch(r[key], r.prev, r.cum, r.step) for r in held.collect()]


def sampled_cut_keys(df: DataFrame, key: str, partitions: int, seed: int = 42, descending: bool = False, per: int = 2000) -> list[Stretch]:
    """The keys in which bounds fall by a sample of about so many rows a partition, all rows of a small table.

    The sample's keys, a bounded number, reach the driver in order.
    """
    rate = min(1.0, per * partitions / max(1, df.count()))
    rows = df.select(key) if rate == 1 else df.select(key).sample(fraction=rate, seed=seed)
    order = F.desc_nulls_last(key) if descending else F.asc_nulls_first(key)
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(order).collect()
    step, cum, out = sum(r.n for r in counts) / partitions, 0, []
    for r in counts:
        prev, cum = cum, cum + r.n
        if prev // step + 1 <= min(cum // step, partitions - 1):
            out.append(Stretch(r[key], prev, cum, step))
    return out


def split_place(
    df: DataFrame, key: str, held: list[Stretch], partitions: int, seed: int = 42, descending: bool = False
) -> DataFrame:
    """df with pid: a row of a key in which bounds fall goes to the range at a random point of the key's stretch.

    Rows are compared with those keys where they lie.
    """
    kind = df.schema[key].dataType
    value = F.struct(F.col(key).cast(kind).alias("k"))
    literal = lambda v: F.struct(F.lit(v).cast(kind).alias("k"))
    after = (lambda v, b: v > literal(b)) if descending else (lambda v, b: v < literal(b))
    spot = F.rand(seed)

    def leaf(i: int) -> Column:
        """Rows from the key of bound i - 1 on, before that of bound i."""
        if not i:
            return F.lit(0)
        r = held[i - 1]
        inside = F.floor((F.lit(float(r.prev)) + spot * F.lit(float(r.cum - r.prev))) / F.lit(float(r.step))).cast("int")
        return F.when(value == literal(r.key), inside).otherwise(F.lit(int(r.cum // r.step)))

    pid = decided(value, [r.key for r in held], leaf, after)
    return df.withColumn("pid", F.least(F.lit(partitions - 1), pid).cast("int"))


def balanced_sort(
    df: DataFrame, key: str, partitions: int, descending: bool = False, seed: int = 42, positions: bool = True
) -> DataFrame:
    """df sorted by key over so many partitions of even size, heavy keys split; pid and, if wanted, position, from 1, are added.

    Bounds come from a sample of the keys.
    """
    held = sampled_cut_keys(df, key, partitions, seed, descending)
    sent = split_place(df, key, held, partitions, seed, descending).repartitionById(partitions, F.col("pid"))
    if not positions:
        return sent.sortWithinPartitions("pid", F.desc_nulls_last(key) if descending else F.asc_nulls_first(key))
    direction = "desc nulls last" if descending else "asc nulls first"
    ranked = materialize(sent.withColumn("position", F.expr(f"row_number() over (partition by pid order by `{key}` {direction})")), "sorted")
    offsets = ranked.groupBy("pid").agg(F.count("*").alias("n")).withColumn("_before", F.expr("sum(n) over (order by pid) - n")).drop("n")
    joined = ranked.join(F.broadcast(offsets), "pid")  # a row per partition
    return joined.withColumn("position", F.col("_before") + F.col("position")).drop("_before")


def choose(cfg: PlanConfig, left: DataFrame, right: DataFrame | None, keys: Sequence[str], optype: str, combined: bool = False) -> Plan | None:
    """The plan for an operator, or None for hashing alone.

    combined: rows are merged by key within each input partition before they are sent.
    """
    if cfg.strategy == "split_range":
        raise ValueError("split_range parts equal keys: it serves sorts, not joins or aggregations")
    if cfg.strategy == "hash":
        return None
    loads = key_loads(left, right, keys, optype, cfg, combined=combined)
    if cfg.strategy in ("minmax", "range"):
        return make_plan(loads, keys, cfg)
    moved = moved_keys(loads, keys, cfg)
    return _plan_of(moved, loads, keys) if moved else None
