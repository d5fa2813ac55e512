"""Sharding against a plain search over all groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evenload.llm import sharding


def greedy(sizes, shards, cap):
    used, room = 1, cap
    for s in sizes:
        if s > cap:
            return False
        if s > room:
            used, room = used + 1, cap
        room -= s
    return used <= shards


def least(sizes, shards):
    cap = max(sizes)
    while not greedy(sizes, shards, cap):
        cap += 1
    return cap


def brute(sizes, shards):
    """The shard of each size in order: even in turn, by looking at every place for every cut."""
    cap, out, at = least(sizes, shards), [], 0
    shards = min(shards, len(sizes))
    for left in range(shards, 0, -1):
        if left == 1:
            best = len(sizes)
        else:
            goal, best = sum(sizes[at:]) / left, None
            for p in range(at + 1, len(sizes) - left + 2):
                fits = sum(sizes[at:p]) <= cap and greedy(sizes[p:], left - 1, cap)
                if fits and (best is None or abs(sum(sizes[at:p]) - goal) < abs(sum(sizes[at:best]) - goal)):
                    best = p
        out += [shards - left] * (best - at)
        at = best
    return cap, out


@pytest.mark.parametrize(("n", "shards"), [(40, 3), (400, 16), (17, 16), (5, 16), (1, 4)])
def test_shards_equal_a_search_over_all_groups(spark, n, shards, monkeypatch):
    rng = random.Random(n)
    groups = sorted((rng.randrange(-(2**63), 2**63), rng.randint(1, 90)) for _ in range(n))
    df = spark.createDataFrame(groups, "h long, w long")
    want, placed = brute([w for _, w in groups], shards)
    for bits in (2, 14):
        monkeypatch.setattr(sharding, "FIRST_BITS", bits)
        cap, place, cuts = sharding.boundaries(df, shards)
        assert cap == want and not place
        assert [sum(h >= c for c in cuts) for h, _ in groups] == placed


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    heavy = "h" * 2000
    rows = [(i, heavy if rng.random() < 0.2 * seed else f"text {rng.randrange(150)} " + "y" * rng.randrange(60)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    total = sum(len(t) + 1 for _, t in rows)
    sizes = defaultdict(int)
    for _, t in rows:
        sizes[t] += len(t) + 1
    order = sorted(sizes, key=lambda t: (0, -sizes[t], hashed[t]) if sizes[t] * 8 >= total else (1, 0, hashed[t]))
    _, placed = brute([sizes[t] for t in order], 8)
    want = dict(zip(order, placed, strict=True))
    for buckets in (None, 3):
        out = sharding.shard_by_bytes(df, 8, buckets=buckets).collect()
        text = dict(rows)
        assert all(r.shard == want[text[r.doc_id]] for r in out) and len(out) == 600
        assert {r.shard for r in out} == set(range(8))
        for k in range(8):
            slots = {r.doc_id: r.slot for r in out if r.shard == k}
            assert sorted(slots.values()) == list(range(len(slots)))
            if buckets is None:  # one bucket: by id
                assert sorted(slots, key=slots.get) == sorted(slots)


def test_odd_rows(odd):
    out = sharding.shard_by_bytes(odd, 4).collect()
    assert len(out) == odd.count()
    by_text = defaultdict(set)
    for r in odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c")).collect():
        by_text[r.c] |= {x.shard for x in out if x.text_crc32 == r.c}
    assert all(len(s) == 1 for s in by_text.values())
    for k in range(4):
        slots = sorted(r.slot for r in out if r.shard == k)
        assert slots == list(range(len(slots)))
    assert {r.size for r in out if r.doc_id in (3, 4)} == {1}


def test_a_heavy_group_leaves_the_rest_even(spark):
    rows = [(i, "x" * 100) for i in range(400)] + [(1000 + i, f"text {i} " + "y" * (i % 50)) for i in range(800)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    loads = out.groupby("shard")["size"].sum().sort_values().tolist()
    assert len(loads) == 8 and loads[-1] == 400 * 101 and loads[0] > 0.95 * loads[-2]


def test_empty_table(odd):
    assert sharding.shard_by_bytes(odd.limit(0)).count() == 0
