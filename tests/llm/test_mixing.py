"""Mixing: targets by repeated resharing, exact quotas, shares of shards."""

import re
from collections import Counter, defaultdict

import pytest

from evenload.llm import mixing


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by giving the excess away again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    budget = share * sum(sizes.values())
    while open_:
        level = (budget - sum(target[s] for s in names if s not in open_)) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: most * sizes[s] for s in full}
        open_ -= full
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 60)), ["big", "mid", "small", None, "é"][min(4, i % 13)]) for i in range(3000)]
    rows += [(5000, None, "big"), (5001, "", "nothing"), (5002, "\xa0", "mid")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_quotas(docs):
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = reshared(sizes)
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r["size"] * len(r.draws) <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 61 for s in sizes)


def test_reruns_agree_whatever_the_partitions(docs):
    a = {r._id: (r.taken, r.draws) for r in mixing.mix(docs).collect()}
    assert a == {r._id: (r.taken, r.draws) for r in mixing.mix(docs.repartition(11)).collect()}


def test_the_tree_deals_exact_even_parts(spark):
    draws = spark.createDataFrame([(False, f"s{i % 5}", f"{i:04d}", 0) for i in range(1000)], "_no_source boolean, _source string, block string, pass int")
    out = mixing.split_tree(draws, 6, "x").collect()
    shards = Counter(r.shard for r in out)
    assert sorted(shards) == list(range(6)) and sum(shards.values()) == 1000
    assert max(shards.values()) - min(shards.values()) <= 3
    assert len({(r._source, r.block) for r in out}) == 1000
    of_source = Counter((r.shard, r._source) for r in out)
    assert min(of_source.values()) > 15 and max(of_source.values()) < 55


def test_documents_are_repeated_as_drawn(docs):
    want = {r._id: len(r.draws) for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == [*docs.columns, "_shard", "_order"]
    counts = Counter(r.doc_id for r in got.collect())
    assert counts == {i: n for i, n in want.items() if n}
    orders = defaultdict(set)
    for r in got.collect():
        orders[r._shard].add(tuple(r._order))
    assert len(orders) == 16


def test_odd_rows(odd):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and {r.taken for r in out if r["size"] == 0} <= {0}
    mixed = mixing.mixed_documents(odd)
    assert [c for c in mixed.columns if c != "_order"] == [*[c for c in odd.columns if c != "_shard"], "_shard"]
    assert mixed.count() == sum(len(r.draws) for r in out)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_what_is_taken_does_not_depend_on_blocks(docs):
    a, b = ({r._id: r.taken for r in mixing.mix(docs, block_digits=n).collect()} for n in (1, 3))
    assert a == b
