"""Samples of a dataset's keys, by input partition, without a shuffle.

A partition's sample is the rows with the smallest of seeded random numbers, a
uniform sample without replacement kept while streaming, so memory follows the
sample. Weights are rows per sampled row, never below 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenload.config import PlanConfig


def sample_size(rows: int, lower: int, rate: float, factor: float) -> int:
    """Rows to sample of a partition: rate x rows, held between lower and lower x factor."""
    return int(max(lower, min(int(rate * rows), int(lower * factor))))


def lower_bound(cfg: PlanConfig, input_partitions: int) -> int:
    """The least sample of each input partition."""
    return ceil(min(cfg.min_sample * cfg.partitions, 1e6) / input_partitions)


def sample_size_column(rows: Column, lower: Column, rate: float, factor: float) -> Column:
    """sample_size over columns."""
    wanted = F.floor(rows.cast("double") * F.lit(rate)).cast("long")
    return F.greatest(lower.cast("long"), F.least(wanted, F.floor(lower.cast("double") * F.lit(factor)).cast("long")))


def chosen(part_id: int, fraction: float, seed: int) -> bool:
    """Whether an input partition is among the sampled ones: by hash, so order does not bias it."""
    return fraction >= 1 or np.random.default_rng([seed, part_id, 1]).random() < fraction


def _sampled(df: DataFrame, size: dict[int, int] | int, seed: int, fraction: float) -> DataFrame:
    """Rows of df with part_id, part_rows and part_sample: size rows of each chosen partition."""
    schema = T.StructType(
        [T.StructField("part_id", T.IntegerType()), T.StructField("part_rows", T.LongType()), T.StructField("part_sample", T.LongType()), *df.schema.fields]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        if not chosen(part_id, fraction, seed):
            return
        k = size if isinstance(size, int) else size.get(part_id, 0)
        rng, total, held, draws = np.random.default_rng([seed, part_id]), 0, None, np.zeros(0)
        for part in parts:
            table = pa.Table.from_batches([part])
            total += part.num_rows
            held = table if held is None else pa.concat_tables([held, table])
            draws = np.concatenate([draws, rng.random(part.num_rows)])
            if len(draws) > k:
                best = np.sort(np.argpartition(draws, k - 1)[:k]) if k else np.zeros(0, np.int64)
                held, draws = held.take(pa.array(best)), draws[best]
        if held is None or not len(draws):
            return
        n = len(draws)
        facts = [pa.array(np.full(n, x), t) for x, t in ((part_id, pa.int32()), (total, pa.int64()), (n, pa.int64()))]
        yield from pa.Table.from_arrays([*facts, *held.columns], schema.fieldNames()).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def reservoir(df: DataFrame, k: int, seed: int = 42, fraction: float = 1.0) -> DataFrame:
    """k rows of each input partition (all of a smaller one), with the partition's number, rows and sample."""
    return _sampled(df, k, seed, fraction)


def partition_sizes(df: DataFrame) -> dict[int, int]:
    """Rows of each input partition; a row per partition reaches the driver."""
    return {r.p: r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}


def exact_rate(df: DataFrame, lower: int, rate: float, factor: float = 1e7, seed: int = 42, fraction: float = 1.0) -> DataFrame:
    """sample_size rows of each input partition: its rows are counted first, then sampled."""
    sizes = {p: sample_size(n, lower, rate, factor) for p, n in partition_sizes(df).items()}
    return _sampled(df, sizes, seed, fraction)


def bernoulli(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each row with the same chance."""
    return df.sample(fraction=fraction, seed=seed)


def by_rank(df: DataFrame, part: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each part by a given order, with part_rows and part_sample: a reproducible sample."""
    from pyspark.sql import Window

    w = Window.partitionBy("part_id")
    ranked = df.withColumn("part_id", part).withColumns(
        {"_rank": F.row_number().over(w.orderBy(*order)), "part_rows": F.count("*").over(w)}
    )
    return ranked.where(F.col("_rank") <= n).drop("_rank").withColumn("part_sample", F.least(F.lit(n), F.col("part_rows")))


def key_sketch(sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(part_id, keys, freq, weight): key frequencies of a sample and rows per sampled row."""
    return sample.groupBy("part_id", *keys).agg(
        F.count("*").alias("freq"), F.max(F.col("part_rows") / F.col("part_sample")).alias("weight")
    )


def distinct_keys(sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(part_id, keys): which keys occur in each partition's sample."""
    return sample.select("part_id", *keys).distinct()


def weighted_keys(df: DataFrame, keys: Sequence[str], per_partition: int, seed: int = 42) -> DataFrame:
    """(keys, weight): sampled keys and one over the chance of being sampled."""
    return reservoir(df.select(*keys), per_partition, seed).select(
        *keys, (F.col("part_rows") / F.col("part_sample")).alias("weight")
    )


def estimated_rows(df: DataFrame, keys: Sequence[str], cfg: PlanConfig, combined: bool = False) -> DataFrame:
    """(keys, v): rows per key, exact or estimated as cfg.sampler says.

    combined: after map-side combining, a key has one row per partition that holds it.
    """
    keyed = df.select(*keys)
    parts = None
    if cfg.sampler == "exact":
        if not combined:
            return keyed.groupBy(*keys).agg(F.count("*").cast("double").alias("v"))
        held = keyed.withColumn("_part", F.spark_partition_id()).distinct()
        return held.groupBy(*keys).agg(F.count("*").cast("double").alias("v"))
    if cfg.sampler == "bernoulli":
        if combined:
            held = bernoulli(keyed.withColumn("_part", F.spark_partition_id()), cfg.sample_rate, cfg.seed).distinct()
            return held.groupBy(*keys).agg(F.count("*").cast("double").alias("v"))
        counted = bernoulli(keyed, cfg.sample_rate, cfg.seed).groupBy(*keys)
        return counted.agg((F.count("*") / F.lit(cfg.sample_rate)).alias("v"))
    parts = max(1, len(partition_sizes(keyed)))
    lower = lower_bound(cfg, parts)
    if cfg.sampler == "reservoir":
        sample = reservoir(keyed, lower, cfg.seed, cfg.partition_fraction)
    else:
        sample = exact_rate(keyed, lower, cfg.sample_rate, cfg.max_sample_factor, cfg.seed, cfg.partition_fraction)
    sketch = key_sketch(sample, keys)
    if combined:
        return sketch.groupBy(*keys).agg(F.count("*").cast("double").alias("v"))
    share = F.lit(float(min(1.0, cfg.partition_fraction)))
    return sketch.groupBy(*keys).agg((F.sum(F.col("freq") * F.col("weight")) / share).alias("v"))
