"""Workloads: PageRank, sorting and counting words, a skewed generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenload.config import PlanConfig
from evenload.operators.placed import reduce_by_key
from evenload.plans.placement import balanced_sort
from evenload.scratch import materialize
from evenload.sources.text import parse_words

DAMPING = 0.85


def pagerank(edges: DataFrame, iterations: int = 15, cut: int = 3) -> DataFrame:
    """(url, rank) from edges (src, dst): unnormalised ranks after so many rounds.

    Repeated edges count once. Sources start at 1; later rounds have only pages
    with in-links, and pages without out-links pass nothing on. Every cut rounds
    the ranks are written, which bounds the lineage and survives lost executors.
    """
    unique = edges.select("src", "dst").distinct()
    degree = unique.groupBy("src").agg(F.count("*").alias("degree"))
    links = materialize(unique.join(degree, "src"), "links")
    ranks = links.select(F.col("src").alias("url")).distinct().withColumn("rank", F.lit(1.0))
    for i in range(iterations):
        passed = links.join(ranks, F.col("src") == F.col("url")).select("dst", (F.col("rank") / F.col("degree")).alias("part"))
        ranks = passed.groupBy(F.col("dst").alias("url")).agg(F.sum("part").alias("_sum")).select(
            "url", (F.lit(1 - DAMPING) + F.lit(DAMPING) * F.col("_sum")).alias("rank")
        )
        if (i + 1) % cut == 0 and i + 1 < iterations:
            ranks = materialize(ranks, "ranks")
    return ranks


def sort_words(lines: DataFrame, partitions: int, column: str = "value") -> DataFrame:
    """(position, word): all words of the lines in order, over partitions of even size."""
    return balanced_sort(parse_words(lines, column), "word", partitions).select("position", "word")


def skewed_pairs(spark: SparkSession, mappers: int, pairs: int, keys: int, ratio: int, partitions: int, seed: int = 42) -> DataFrame:
    """(k, v): pairs per mapper; every residue has as many rows, but residue 0 about ratio times the keys.

    The skew shows once rows are combined by key. keys must be at least ratio.
    """
    if keys < ratio:
        raise ValueError("keys must be at least ratio")
    draw = lambda n, s: F.floor(F.rand(seed + s) * F.lit(n)).cast("int")
    heavy = draw(keys, 1) * partitions
    light = 1 + draw(partitions - 1, 2) + draw(keys // ratio, 3) * partitions
    key = F.when(F.rand(seed) < 1 / partitions, heavy).otherwise(light) if partitions > 1 else heavy
    return spark.range(0, mappers * pairs, 1, mappers).select(key.cast("int").alias("k"), F.lit(1).alias("v"))


def count_by_key(pairs: DataFrame, cfg: PlanConfig | None = None) -> DataFrame:
    """(k, v): the sum of v of each key."""
    return reduce_by_key(pairs, ["k"], {"v": "sum"}, cfg).select("k", "v")
