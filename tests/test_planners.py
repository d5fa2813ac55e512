"""Planners: worked cases, and properties on random loads."""

from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenload.plans.planners import KeyLoad, best_fit, first_fit, loads_after, minmax_cuts, shed


def keyed(weights: dict[int, float], partitions: int) -> list[KeyLoad]:
    return [KeyLoad(k, float(w), k % partitions) for k, w in weights.items()]


def test_reassignment_worked_by_hand():
    keys = keyed({0: 10, 2: 6, 4: 4, 1: 2}, 2)
    assert [k.key for k in shed(keys, 2, 1.2).movable] == [2, 4]
    assert first_fit(keys, 2) == best_fit(keys, 2) == {2: 1, 4: 1}
    assert loads_after(keys, {2: 1, 4: 1}, 2) == [10, 12]


def test_one_heavy_key_stays():
    keys = keyed({0: 100, 1: 1, 2: 1}, 2)
    assert 0 not in first_fit(keys, 2) and 0 not in best_fit(keys, 2)


def test_minmax_worked_case():
    weights = [11, 3, 9, 1, 7, 3, 4, 8]
    cuts = minmax_cuts(weights, 4)
    assert cuts == [0, 2, 5]


@pytest.mark.parametrize("weights", [[], [5], [5, 1]])
def test_minmax_with_few_weights(weights):
    assert minmax_cuts(weights, 4) == list(range(max(0, len(weights) - 1)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=2, max_size=9), st.integers(2, 5))
def test_minmax_is_least(weights, segments):
    segments = min(segments, len(weights))
    n = len(weights)

    def largest(cuts):
        ends = [c + 1 for c in cuts]
        return max(sum(weights[a:b]) for a, b in zip([0, *ends], [*ends, n], strict=True))

    least = min(largest([c - 1 for c in cut]) for cut in combinations(range(1, n), segments - 1))
    assert largest(minmax_cuts(weights, segments)) == least


@settings(max_examples=200, deadline=None)
@given(
    st.dictionaries(st.integers(0, 200), st.integers(1, 100), min_size=1, max_size=60),
    st.integers(1, 9),
    st.sampled_from([1.0, 1.2, 2.0]),
    st.sampled_from([first_fit, best_fit]),
)
def test_plans_move_only_from_overloaded_buckets(weights, partitions, tolerance, planner):
    keys = keyed(weights, partitions)
    plan = planner(keys, partitions, tolerance)
    hashed = loads_after(keys, {}, partitions)
    mean = sum(hashed) / partitions
    assert all(0 <= p < partitions for p in plan.values())
    assert all(hashed[k.bucket] > tolerance * mean for k in keys if k.key in plan)
    assert sum(loads_after(keys, plan, partitions)) == pytest.approx(sum(hashed))
    assert set(plan) == {k.key for k in shed(keys, partitions, tolerance).movable}
    assert planner(list(reversed(keys)), partitions, tolerance) == plan
