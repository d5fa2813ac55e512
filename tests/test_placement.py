"""Placement changes where rows lie and never what a query returns."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from evenload.config import PlanConfig
from evenload.operators import metrics, placed
from evenload.plans import placement
from evenload.plans.prefix import running_total

CFG = PlanConfig(partitions=4)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(200)] + [(None, -1), (50, 1), (50, 1)], "k long, a long")
    right = spark.createDataFrame([(k % 5, -k) for k in range(30)] + [(None, 9)], "k long, b long")
    return left, right


def plain(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_anti"])
@pytest.mark.parametrize("strategy", ["hash", "range", "first_fit", "best_fit", "minmax"])
def test_joins_equal_stock(sides, how, strategy):
    left, right = sides
    got = placed.placed_join(left, right, ["k"], how, replace(CFG, strategy=strategy)).drop("pid")
    assert plain(got) == plain(left.join(right, "k", how))


@pytest.mark.parametrize("sampler", ["reservoir", "rejection", "bernoulli"])
def test_sampled_plans_equal_stock(sides, sampler):
    left, right = sides
    got = placed.placed_join(left, right, ["k"], "inner", replace(CFG, sampler=sampler)).drop("pid")
    assert plain(got) == plain(left.join(right, "k"))


def test_null_safe(sides):
    left, right = sides
    got = placed.placed_join(left, right, ["k"], "inner", CFG, null_safe=True)
    assert got.where("k is null").count() == 1
    anti = placed.placed_join(left, left, ["k"], "left_anti", CFG)
    assert anti.count() == 1
    assert placed.placed_join(left, left, ["k"], "left_anti", CFG, null_safe=True).count() == 0


def test_split_range_cannot_join(sides):
    with pytest.raises(ValueError):
        placed.placed_join(*sides, ["k"], "inner", replace(CFG, strategy="split_range"))


def test_grouping_where_it_lies_adds_no_exchange(sides):
    left, right = sides
    out = placed.placed_join(left, right, ["k"], "inner", replace(CFG, strategy="hash"))
    assert metrics.exchanges(out.groupBy("pid", "k").count()) == 2
    assert metrics.exchanges(out.groupBy("k").count()) == 3


def test_rows_lie_where_the_plan_says(spark, sides):
    left, _ = sides
    loads = placement.key_loads(left, None, ["k"], "sort", CFG)
    plan = placement.make_plan(loads, ["k"], CFG)
    sent = placement.place(left, ["k"], plan, 4).withColumn("at", F.spark_partition_id())
    assert sent.where("at <> pid").count() == 0


def test_reduce_combines_first(spark):
    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("n"))
    local = placed.combined_locally(df, ["k"], {"id": "max", "n": "sum"})
    assert local.count() == 12
    got = placed.reduce_by_key(df, ["k"], {"id": "max", "n": "sum"}, CFG).drop("pid")
    assert plain(got) == plain(df.groupBy("k").agg(F.max("id").alias("id"), F.sum("n").alias("n")))


def test_string_and_array_keys(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("b", [1, 2]), ("a", [3]), (None, None)], "s string, v array<int>")
    for key in ("s", "v"):
        got = df.select(key, placement.hash_bucket(df, [key], 4).alias("b")).distinct()
        assert got.count() == 3
        assert got.where(f"{key} is null").first().b == 0


def test_integer_keys_fold_to_32_bits(spark):
    df = spark.createDataFrame([(5,), (-1,), (2**32 + 1,), (None,)], "k long")
    assert [r[0] for r in df.select(placement.hash_bucket(df, ["k"], 8)).collect()] == [5, 0, 0, 0]


def test_split_bounds_worked_by_hand(spark):
    w = spark.createDataFrame([("a", 2), ("b", 10), ("c", 3)], "k string, weight long")
    split = placement.split_range(w, "k", 4)
    got = sorted(map(tuple, placement.split_bounds(split, "k", 4).collect()))
    assert [(j, k) for j, k, _ in got] == [(1, "b"), (2, "b"), (3, "b")]
    assert [r for *_, r in got] == pytest.approx([0.175, 5 / 11, 5 / 6])
    shares = placement.split_shares(split, "k", 4).where("k = 'b'").orderBy("pid").collect()
    assert [r.load / 10 for r in shares] == pytest.approx([0.175, 0.375, 0.375, 0.075])
    every = placement.split_shares(split, "k", 4).groupBy("pid").agg(F.sum("load").alias("l")).collect()
    assert [r.l for r in every] == pytest.approx([3.75] * 4)


@pytest.mark.parametrize("descending", [False, True])
def test_balanced_sort(spark, descending):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    got = placement.balanced_sort(df, "k", 4, descending).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 1001))
    assert [r.k for r in got] == sorted((r.k for r in got), reverse=descending)
    assert metrics.max_over_mean(metrics.balance(placement.balanced_sort(df, "k", 4).select("pid"), 4, pid="pid")).first().peak < 1.3


def test_running_total(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("w"))
    got = {r.id: (r.cum, r.grand) for r in running_total(df, ["id"], "w").collect()}
    total = 0
    for i in range(100):
        total += i % 7
        assert got[i][0] == total
    assert got[0][1] == total


def test_metrics(spark):
    loads = spark.createDataFrame([(10,), (12,)], "rows long")
    assert metrics.fos(loads).first().fos == pytest.approx(1 / 11)
    assert metrics.fos(spark.createDataFrame([(4,), (0,)], "rows long")).first().fos == 1
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 3)], "k int, p int")
    assert [tuple(r) for r in metrics.balance(df, 4, ["k"], "p").orderBy("pid").collect()] == [(0, 2, 1), (1, 0, 0), (2, 0, 0), (3, 1, 1)]


@pytest.mark.parametrize("strategy", ["minmax", "range"])
def test_ranges_exchange_each_side_once(sides, strategy):
    left, right = sides
    out = placed.placed_join(left, right, ["k"], "inner", replace(CFG, strategy=strategy))
    assert metrics.exchanges(out.groupBy("pid", "k").count()) == 2


def test_a_sort_exchanges_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 9).alias("k"))
    out = placement.balanced_sort(df, "k", 4, positions=False)
    assert metrics.exchanges(out) == 1
    ks = [r.k for r in out.collect()]
    assert ks == sorted(ks) and len(ks) == 1000


@pytest.mark.parametrize("descending", [False, True])
def test_split_rows_follow_the_shares(spark, descending):
    rows = [(None,)] * 300 + [("a",)] * 50 + [("b",)] * 1500 + [(c,) for c in "cdefgh" * 25]
    df = spark.createDataFrame(rows, "k string")
    split = placement.split_range(df.groupBy("k").agg(F.count("*").alias("weight")), "k", 5, descending=descending)
    want = {(r.pid, r.k): r.load for r in placement.split_shares(split, "k", 5).collect()}
    got = placement.split_place(df, "k", placement.cut_keys(split, "k", 5), 5, descending=descending).groupBy("pid", "k").count().collect()
    assert {(r.pid, r.k) for r in got} <= set(want)
    for r in got:
        share = next(n for k, n in ((None, 300), ("a", 50), ("b", 1500), *((c, 25) for c in "cdefgh")) if k == r.k)
        assert r["count"] == share or abs(r["count"] - want[r.pid, r.k]) < 5 * (share**0.5)
    per = {}
    for r in got:
        per.setdefault(r.pid, []).append(r.k)
    flat = [sorted(per[p], key=lambda k: (k is not None, k or ""), reverse=descending) for p in sorted(per)]
    order = [k for part in flat for k in part]
    assert [k for i, k in enumerate(order) if not i or order[i - 1] != k] == sorted(set(order), key=lambda k: (k is not None, k or ""), reverse=descending)


def test_sampled_cuts_even_out(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.lit("m")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"))
    held = placement.sampled_cut_keys(df, "k", 6, per=1000)
    assert 0 < len(held) < 6
    sent = placement.split_place(df, "k", held, 6)
    assert metrics.max_over_mean(metrics.balance(sent, 6, pid="pid")).first().peak < 1.15
    assert placement.sampled_cut_keys(df.limit(0), "k", 6) == []


def test_bounds_of_several_keys_and_nulls(spark):
    rows = [(a, b, p) for p, (a, b) in enumerate([(None, None), (None, "x"), (1, None), (1, "m"), (2, "a")])]
    plan = placement.bounds_of(spark.createDataFrame(rows, "a int, b string, pid int"), ["a", "b"])
    asked = spark.createDataFrame([(None, None), (None, "a"), (None, "z"), (0, "q"), (1, None), (1, "a"), (1, "z"), (2, "a"), (9, None)], "a int, b string")
    assert [r.pid for r in placement.with_pid(asked, ["a", "b"], plan, 5).collect()] == [0, 0, 1, 1, 2, 2, 3, 4, 4]
    empty = placement.bounds_of(spark.createDataFrame([], "a int, b string, pid int"), ["a", "b"])
    assert {r.pid for r in placement.with_pid(asked, ["a", "b"], empty, 5).collect()} == {0}


def test_config_is_checked():
    for bad in ({"strategy": "x"}, {"sampler": "x"}, {"partitions": 0}):
        with pytest.raises(ValueError):
            PlanConfig(**bad)
