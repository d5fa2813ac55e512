"""Settings of a placement."""

from __future__ import annotations

from dataclasses import dataclass

#: How keys are placed: whole keys by hash or range, moved keys, split keys, contiguous segments.
STRATEGIES = ("hash", "range", "first_fit", "best_fit", "split_range", "minmax")
#: How key frequencies are estimated.
SAMPLERS = ("exact", "reservoir", "rejection", "bernoulli")


@dataclass(frozen=True)
class PlanConfig:
    """What a planner needs to know.

    tolerance: a bucket is overloaded beyond this multiple of the mean load.
    sample_rate, min_sample, max_sample_factor: see sampling.sample_size.
    partition_fraction: share of input partitions that are sampled.
    max_keys: the heaviest keys that a plan may move; the rest keep their hash bucket.
    """

    partitions: int = 8
    strategy: str = "first_fit"
    sampler: str = "bernoulli"
    sample_rate: float = 0.2
    tolerance: float = 1.2
    min_sample: int = 1000
    max_sample_factor: float = 1e7
    partition_fraction: float = 1.0
    max_keys: int = 1_000_000
    seed: int = 42

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if self.sampler not in SAMPLERS:
            raise ValueError(f"sampler must be one of {SAMPLERS}")
        if self.partitions < 1:
            raise ValueError("partitions must be positive")

    @property
    def planned_keys(self) -> int:
        """Bound of the keys that reach the driver."""
        return min(self.max_keys, self.min_sample * self.partitions)
