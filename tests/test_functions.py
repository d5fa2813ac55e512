"""Costs, bounds and codes."""

import pytest
from pyspark.sql import functions as F

from evenload.functions import cost, scalars
from evenload.operators import sampling

TYPES = ["join", "leftOuterJoin", "rightOuterJoin", "fullOuterJoin", "subtractByKey", "joinnull"]


@pytest.mark.parametrize(
    ("v1", "v2", "want"),
    [(3, 2, [11, 11, 11, 11, 5, 5]), (3, 0, [3, 6, 3, 6, 6, 3]), (0, 2, [2, 2, 4, 4, 2, 2])],
)
def test_two_sided_costs(spark, v1, v2, want):
    df = spark.createDataFrame([(v1, v2)], "a int, b int")
    got = df.select(*[cost.key_weight(t, F.col("a"), F.col("b")).alias(t) for t in TYPES]).first()
    assert list(got) == want


def test_one_sided_costs(spark):
    df = spark.createDataFrame([(4,)], "v int")
    types = ["groupByKey", "combine", "reduceByKey", "null"]
    assert list(df.select(*[cost.key_weight(t, F.col("v")).alias(t) for t in types]).first()) == [5, 5, 5, 8]
    assert df.select(cost.key_weight("join", F.col("v"), assume_symmetric=True)).first()[0] == 24
    with pytest.raises(ValueError):
        cost.key_weight("join", F.col("v"))


def test_scaled_rows_never_undercount(spark):
    df = spark.createDataFrame([(2, 10, 5), (3, 4, 100)], "f int, n int, s int")
    assert [r[0] for r in df.select(cost.scaled(F.col("f"), F.col("n"), F.col("s"))).collect()] == [4, 3]


def test_bounds():
    assert scalars.poisson_upper(4) == 28 and scalars.poisson_upper(9) == 36 and scalars.poisson_upper(100) == 160
    assert scalars.poisson_lower(4) == 1e-15 and scalars.poisson_lower(100) == 40
    assert scalars.binomial_upper(1e-4, 10, 1.0) == 1
    rate = scalars.fraction_for(100, 10_000)
    assert 0.01 < rate < 0.02
    assert scalars.binomial_lower(1e-4, 10_000, 0.01) < 0.01
    assert scalars.fraction_for(100, 10_000, replacement=True) == pytest.approx(0.016)


def test_size_code_is_within_a_tenth(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 2, 10, 1000, 123456, 10**9, 3 * 10**10)], "s long")
    for r in df.select("s", scalars.size_decode(scalars.size_code(F.col("s"))).alias("d")).collect():
        assert r.d == pytest.approx(r.s, rel=0.1, abs=1)


def test_sample_size():
    assert [sampling.sample_size(n, 100, 0.2, 10) for n in (10, 1000, 100_000)] == [100, 200, 1000]
