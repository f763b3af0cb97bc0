"""Settings of a k-nearest-neighbour run."""

from __future__ import annotations

from dataclasses import dataclass

CURVES = ("z", "gray", "hilbert")


@dataclass(frozen=True)
class KnnConfig:
    """One run's parameters; immutable, so a tuner derives new ones with ``dataclasses.replace``.

    ``epsilon`` sets the size of the samples by which the join's work is cut, ``scale_domain`` the largest factors
    that a tuner tries.
    """

    k: int = 15
    shifts: int = 2
    dimension: int = 9
    classes: int = 2
    epsilon: float = 0.003
    partitions: int = 8
    curve: str = "z"
    task: str = "classify"
    folds: int = 10
    scale: tuple[float, ...] = ()
    scale_domain: tuple[int, ...] = ()
    bits: int = 32
    seed: int = 17
    max_shift: int = 10000

    def __post_init__(self) -> None:
        if self.curve not in CURVES:
            raise ValueError(f"curve must be one of {CURVES}")
        if self.task not in ("classify", "regress"):
            raise ValueError("task must be classify or regress")
        if min(self.k, self.shifts, self.dimension, self.partitions) < 1:
            raise ValueError("k, shifts, dimension and partitions must be positive")
        if self.epsilon <= 0:
            raise ValueError("epsilon must be positive")
        if self.scale_domain and len(self.scale_domain) != self.dimension:
            raise ValueError("scale_domain needs one limit for each dimension")
        if self.scale and len(self.scale) != self.dimension:
            raise ValueError("scale needs one factor for each dimension")
