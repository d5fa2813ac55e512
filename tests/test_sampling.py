"""Samples are uniform, reproducible and add up."""

import pytest
from pyspark.sql import functions as F

from evenload.config import PlanConfig
from evenload.operators import sampling


def numbers(spark, n=4000, parts=4):
    return spark.range(0, n, 1, parts).select((F.col("id") % 10).alias("k"), "id")


def test_reservoir(spark):
    df = numbers(spark)
    got = sampling.reservoir(df, 50, seed=1).toPandas()
    assert got.groupby("part_id").size().tolist() == [50] * 4 and set(got.part_rows) == {1000}
    assert got.id.is_unique
    again = sampling.reservoir(df, 50, seed=1).toPandas()
    assert sorted(got.id) == sorted(again.id)
    assert sorted(got.id) != sorted(sampling.reservoir(df, 50, seed=2).toPandas().id)


def test_small_partitions_keep_all_rows(spark):
    sketch = sampling.key_sketch(sampling.reservoir(numbers(spark, 40), 500), ["k"]).toPandas()
    assert set(sketch.weight) == {1.0} and sketch.freq.sum() == 40


def test_every_row_is_as_likely(spark):
    hits = [0] * 20
    for seed in range(150):
        for r in sampling.reservoir(spark.range(0, 20, 1, 1), 5, seed).collect():
            hits[r.id] += 1
    assert min(hits) > 15 and max(hits) < 65


@pytest.mark.parametrize("sampler", ["exact", "reservoir", "rejection", "bernoulli"])
def test_estimates_add_up(spark, sampler):
    cfg = PlanConfig(sampler=sampler, min_sample=100, partitions=4)
    rows = sampling.estimated_rows(numbers(spark), ["k"], cfg).agg(F.sum("v")).first()[0]
    assert rows == pytest.approx(4000, rel=0.15 if sampler == "bernoulli" else 1e-9)


def test_combined_estimates_count_partitions(spark):
    for sampler in ("exact", "rejection"):
        got = sampling.estimated_rows(numbers(spark), ["k"], PlanConfig(sampler=sampler), combined=True).collect()
        assert {r.v for r in got} == {4.0}


def test_partition_fraction_picks_by_hash(spark):
    picked = {r.part_id for r in sampling.reservoir(numbers(spark, parts=16), 5, fraction=0.5).collect()}
    assert 0 < len(picked) < 16 and picked != set(range(len(picked)))


def test_empty(spark):
    assert sampling.reservoir(numbers(spark).limit(0), 5).count() == 0
    assert sampling.exact_rate(numbers(spark).limit(0), 5, 0.5).count() == 0
