"""Key-to-partition planners over a bounded table of key loads; no Spark here.

All orders have ties broken: keys by (weight descending, key), buckets by
(load, number), so equal input gives equal plans.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Hashable, Iterable, Sequence
from dataclasses import dataclass
from itertools import accumulate
from typing import NamedTuple


class KeyLoad(NamedTuple):
    """A key, what it costs, and the bucket that hashing gives it."""

    key: Hashable
    weight: float
    bucket: int


@dataclass(frozen=True)
class Overload:
    """What is left to place after overloaded buckets gave up what does not fit."""

    mean: float
    loads: list[float]
    movable: list[KeyLoad]


def heaviest_first(keys: Iterable[KeyLoad]) -> list[KeyLoad]:
    """Keys by weight, the largest first."""
    return sorted(keys, key=lambda k: (-k.weight, k.key))


def shed(keys: Sequence[KeyLoad], partitions: int, tolerance: float, fixed: Sequence[float] | None = None) -> Overload:
    """Keys that overloaded buckets give up.

    A bucket beyond tolerance x mean keeps its heaviest key and then, by weight,
    every key that still fits below that bound. fixed: load per bucket that
    cannot move (keys that were not listed).
    """
    loads = [float(x) for x in fixed] if fixed else [0.0] * partitions
    stuck = list(loads)
    by_bucket: dict[int, list[KeyLoad]] = {}
    for k in keys:
        loads[k.bucket] += k.weight
        by_bucket.setdefault(k.bucket, []).append(k)
    mean = sum(loads) / partitions
    bound = mean * tolerance
    movable: list[KeyLoad] = []
    for bucket in range(partitions):
        if loads[bucket] <= bound:
            continue
        held = stuck[bucket]
        for rank, k in enumerate(heaviest_first(by_bucket.get(bucket, []))):
            if rank == 0 or held + k.weight <= bound:
                held += k.weight
            else:
                movable.append(k)
        loads[bucket] = held
    return Overload(mean, loads, movable)


def first_fit(keys: Sequence[KeyLoad], partitions: int, tolerance: float = 1.2, fixed: Sequence[float] | None = None) -> dict[Hashable, int]:
    """Moved keys and their new bucket: buckets, the emptiest first, fill up to the mean in list order.

    What fits nowhere is dealt by weight, one key to each bucket, again the emptiest first.
    """
    state = shed(keys, partitions, tolerance, fixed)
    loads, waiting, plan = list(state.loads), list(state.movable), {}
    for bucket in sorted(range(partitions), key=lambda b: (loads[b], b)):
        later = []
        for k in waiting:
            if 0 < k.weight <= state.mean - loads[bucket]:
                plan[k.key] = bucket
                loads[bucket] += k.weight
            else:
                later.append(k)
        waiting = later
    emptiest = sorted(range(partitions), key=lambda b: (loads[b], b))
    for at, k in enumerate(heaviest_first(k for k in waiting if k.weight > 0)):
        plan[k.key] = emptiest[at % partitions]
    return plan


def best_fit(keys: Sequence[KeyLoad], partitions: int, tolerance: float = 1.2, fixed: Sequence[float] | None = None) -> dict[Hashable, int]:
    """Moved keys and their new bucket: by weight, each to the tightest room it fits, else to the largest."""
    state = shed(keys, partitions, tolerance, fixed)
    rooms = sorted((state.mean - load, bucket) for bucket, load in enumerate(state.loads))
    plan = {}
    for k in heaviest_first(state.movable):
        at = min(bisect_left(rooms, (k.weight, -1)), partitions - 1)
        room, bucket = rooms.pop(at)
        plan[k.key] = bucket
        insort(rooms, (room - k.weight, bucket))
    return plan


def segment_sums(weights: Sequence[float], cuts: Sequence[int]) -> list[float]:
    """The sum of each segment."""
    ends = [c + 1 for c in cuts]
    return [sum(weights[a:b]) for a, b in zip([0, *ends], [*ends, len(weights)], strict=True)]


def minmax_cuts(weights: Sequence[float], segments: int) -> list[int]:
    """The last index of each segment but the last, for contiguous segments whose largest sum is least.

    With fewer weights than segments, each weight is alone and the rest are
    empty. Where one weight alone sets the largest sum, what lies on its two
    sides is evened out by the same rule.
    """
    n = len(weights)
    if n <= segments:
        return list(range(max(0, n - 1)))
    cuts = _least_cuts(weights, segments)
    least = max(segment_sums(weights, cuts))
    at = max(range(n), key=lambda i: weights[i])
    if segments == 1 or weights[at] < least:
        return cuts
    left, right = weights[:at], weights[at + 1 :]
    options = [s for s in range(segments) if bool(left) <= s <= segments - 1 - bool(right)]
    if not options:
        return cuts
    share = lambda part, s: sum(part) / s if part else 0.0
    s = min(options, key=lambda s: max(share(left, s), share(right, segments - 1 - s)))
    even = [*(minmax_cuts(left, s) if left else []), *([at - 1] if left else []), *([at] if right else [])]
    even += [at + 1 + c for c in minmax_cuts(right, segments - 1 - s)] if right else []
    return even if max(segment_sums(weights, even)) <= least else cuts


def _least_cuts(weights: Sequence[float], segments: int) -> list[int]:
    """Any cuts whose largest sum is least; there are more weights than segments."""
    n = len(weights)
    sums = [0.0, *accumulate(weights)]
    # reach[s][i]: the least largest sum of the first i weights in s segments, and where the last one starts
    best = [sums[i] for i in range(n + 1)]
    starts: list[list[int]] = []
    for _ in range(segments - 1):
        new, start = [0.0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            # best[j] rises and sums[i] - sums[j] falls with j: the least maximum is where they cross
            low, high = 0, i - 1
            while low < high:
                mid = (low + high) // 2
                if best[mid] >= sums[i] - sums[mid]:
                    high = mid
                else:
                    low = mid + 1
            options = [j for j in (low - 1, low) if 0 <= j < i]
            start[i] = min(options, key=lambda j: (max(best[j], sums[i] - sums[j]), -j))
            new[i] = max(best[start[i]], sums[i] - sums[start[i]])
        best = new
        starts.append(start)
    cuts, end = [], n
    for start in reversed(starts):
        end = start[end]
        cuts.append(end - 1)
    return cuts[::-1]


def loads_after(keys: Sequence[KeyLoad], plan: dict[Hashable, int], partitions: int) -> list[float]:
    """The load of each bucket when the plan overrides hashing."""
    loads = [0.0] * partitions
    for k in keys:
        loads[plan.get(k.key, k.bucket)] += k.weight
    return loads
