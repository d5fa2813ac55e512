"""Near-dedup of vectors against all pairs."""

import numpy as np
import pytest

from evenload.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, unit string"


def brute(rows):
    good = {}
    for k, (i, v, label, _) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(np.float64)
            good[k] = u / np.sqrt(u @ u)
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.93:
                links[a].add(b)
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((row[0], len(links[k]), min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)))
    return sorted(out, key=str)


def found(df):
    out, recall = near_vectors.near_vectors(df)
    return sorted(((r._id, r.n_links, r.component_id) for r in out.collect()), key=str), recall


@pytest.mark.parametrize("block", [512, 8])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for size in (1, 1, 1, 2, 2, 3, 8, 40, *[1] * 60):
            base = rng.normal(size=24)
            for _ in range(size):
                rows.append([0, (base + rng.normal(size=24) * rng.choice([0, 0.1, 0.2])).tolist(), label, "x"])
    rng.shuffle(rows)
    for i, r in enumerate(rows):
        r[0] = i
    rows = [(int(i), [float(np.float32(x)) for x in v], int(l), u) for i, v, l, u in rows]
    got, recall = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and recall == 1


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    one = [1.0, 2.0, 3.0]
    rows = [
        (100, one, 1, None), (2, one, 1, None), (2, one, 1, None), (3, [2.0, 4.0, 6.0], 1, None), (4, one, 2, None),
        (5, one, None, None), (6, None, 1, None), (7, [], 1, None), (8, [0.0, 0.0, 0.0], 1, None), (9, [1.0, None, 3.0], 1, None),
        (10, [1.0, nan, 3.0], 1, None), (11, [inf, 2.0, 3.0], 1, None), (12, [1.0, 2.0], 1, None), (None, one, 1, None),
        (13, [-1.0, -2.0, -3.0], 1, None), (14, [1e30, 2e30, 3e30], 1, None),
    ]
    got, _ = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA))[0] == []


def test_a_large_family_hides_no_lost_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    units = [base + rng.normal(size=64) * 0.05 for _ in range(200)]
    for _ in range(20):
        one = rng.normal(size=64)
        units += [one, one + rng.normal(size=64) * 0.1]
    rows = [(k, 1, 1, (u / np.sqrt(u @ u)).tobytes()) for k, u in enumerate(units)]
    nodes = spark.createDataFrame(rows, "node long, grp long, copies long, unit binary")
    counted = spark.createDataFrame([(k, 199, 199) for k in range(200)] + [(k, 1, 1) for k in range(200, 220)], "node long, linked long, pairs long")
    assert near_vectors.audit(nodes, nodes, counted, 0.93, 3) == 0.5


def test_recall_of_nothing_is_not_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    units = [rng.normal(size=16) for _ in range(60)]
    units[41:] = [units[40] + rng.normal(size=16) * 0.01 for _ in range(19)]
    rows = [(k, 1, 1, (u / np.sqrt(u @ u)).tobytes()) for k, u in enumerate(units)]
    nodes = spark.createDataFrame(rows, "node long, grp long, copies long, unit binary")
    none = spark.createDataFrame([], "node long, linked long, pairs long")
    few = nodes.where("node < 40")
    assert near_vectors.audit(nodes, few, none, 0.93, 3) is None
    monkeypatch.setattr(near_vectors, "PROBES", 10**6)
    assert near_vectors.audited(nodes, 60, none, 0.93, 3) == 0
    assert near_vectors.audited(few, 40, none, 0.93, 3) is None
    # Of 10 ** 18 nodes none of these is drawn, so the linked ones are asked.
    half = spark.createDataFrame([(k, 9, 9) for k in range(40, 60)], "node long, linked long, pairs long")
    assert abs(near_vectors.audited(nodes, 10**18, half, 0.93, 3) - 9 / 19) < 1e-9


def test_short_of_the_aim_all_pairs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "ordered_neighbours", lambda nodes, *_: nodes.sparkSession.createDataFrame([], near_vectors.EDGES))
    monkeypatch.setattr(near_vectors, "WIDE_BLOCK", 8)
    rng = np.random.default_rng(6)
    rows = []
    for size in (1, 2, 3, 9, *[1] * 20):
        base = rng.normal(size=16)
        rows += [(base + rng.normal(size=16) * 0.1).astype(np.float32).tolist() for _ in range(size)]
    rows = [(100 * i + 1, v, i % 2, "x") for i, v in enumerate(rows + rows[:3])]
    out, recall = near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), rounds=0, most_orders=8)
    got = out.collect()
    assert sorted(((r._id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert recall == 1 and {r.recall for r in got} == {1.0}


def test_half_precision_stays_within_the_slack(spark):
    rng = np.random.default_rng(9)
    rows = [(d, np.full(d, 1.0).tolist(), 1, "x") for d in range(1, 400)]  # equal parts round the same way: the most that errors add up to
    rows += [(k, rng.normal(size=8).tolist(), 1, "x") for k in range(50)]
    nodes = spark.createDataFrame(rows, SCHEMA).select(near_vectors.unit("embedding").alias("unit")).select("unit", near_vectors.brief("unit").alias("brief"))
    for r in nodes.collect():
        exact, half = np.frombuffer(r.unit), np.frombuffer(r.brief, np.float16).astype(np.float32)
        assert abs(float(half @ half) - exact @ exact) < near_vectors.SLACK
