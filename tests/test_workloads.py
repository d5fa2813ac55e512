"""PageRank, word count over skew, sorting."""

import pytest
from pyspark.sql import functions as F

from evenload.config import PlanConfig
from evenload.operators import workloads


def test_pagerank_worked_by_hand(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "B"), ("D", "B"), ("A", "B")], "src string, dst string")
    one = {r.url: r.rank for r in workloads.pagerank(edges, 1).collect()}
    assert one == pytest.approx({"B": 2.275, "C": 1.425})
    two = {r.url: r.rank for r in workloads.pagerank(edges, 2).collect()}
    assert two == pytest.approx({"B": 1.36125, "C": 2.08375})
    many = {r.url: r.rank for r in workloads.pagerank(edges, 7, cut=2).collect()}
    assert many == pytest.approx({r.url: r.rank for r in workloads.pagerank(edges, 7, cut=99).collect()})


def test_generator_skews_keys_and_not_rows(spark):
    pairs = workloads.skewed_pairs(spark, 4, 5000, 200, 5, 8).withColumn("r", F.col("k") % 8)
    by = {r.r: (r.n, r.d) for r in pairs.groupBy("r").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).collect()}
    assert len(by) == 8 and max(n for n, _ in by.values()) < 1.2 * min(n for n, _ in by.values())
    assert by[0][1] > 4 * max(d for r, (_, d) in by.items() if r)
    with pytest.raises(ValueError):
        workloads.skewed_pairs(spark, 1, 1, 2, 5, 8)


def test_count_by_key(spark):
    pairs = workloads.skewed_pairs(spark, 2, 500, 50, 5, 4).persist()
    want = {r.k: r.n for r in pairs.groupBy("k").agg(F.count("*").alias("n")).collect()}
    for strategy in ("hash", "first_fit", "best_fit"):
        got = workloads.count_by_key(pairs, PlanConfig(partitions=4, strategy=strategy))
        assert {r.k: r.v for r in got.collect()} == want


def test_sort_words(spark):
    lines = spark.createDataFrame([("b a  c ",), ("",), ("   ",), ("z b",)], "value string")
    got = workloads.sort_words(lines, 3).orderBy("position").collect()
    assert [r.word for r in got] == ["", "", "a", "b", "b", "c", "z"]
