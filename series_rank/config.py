"""Parameters of a run, as plain dataclasses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# The eleven features of one series, and those where less is better.
FEATURES = [
    "ratioMax",
    "ratioMaxX",
    "yMax",
    "yStdRate",
    "yMeanRate",
    "yStdFallRate",
    "yMeanFallRate",
    "dMax",
    "dStdRate",
    "dMeanRate",
    "mAtZero",
]
LOWER_BETTER = [
    "ratioMaxX",
    "yStdRate",
    "yStdFallRate",
    "yMeanFallRate",
    "dMax",
    "dStdRate",
    "dMeanRate",
    "mAtZero",
]

# Default weight of each feature, the same for every regime.
FEATURE_WEIGHTS = {
    "ratioMax": 33,
    "ratioMaxX": 6,
    "yMax": 30,
    "yStdRate": 15,
    "yMeanRate": 18,
    "yStdFallRate": 21,
    "yMeanFallRate": 24,
    "dMax": 27,
    "dStdRate": 9,
    "dMeanRate": 12,
    "mAtZero": 3,
}

# Gate threshold, factor caps and the shortlist length.
MIN_FALL_POINTS = 7
MAX_FACTORS_LOWER = 8
MAX_FACTORS_HIGHER = 3
MAX_FACTORS_JOINT = 10
TOP_N = 5


def feature_columns(regimes: Sequence[str], features: Sequence[str] = FEATURES) -> list[str]:
    """Wide column names, regime by regime in feature order."""
    return [f"{r}_{f}" for r in regimes for f in features]


def default_weights(regimes: Sequence[str]) -> dict[str, float]:
    return {f"{r}_{f}": float(w) for r in regimes for f, w in FEATURE_WEIGHTS.items()}


def named_weights(values: Sequence[float], columns: Sequence[str]) -> dict[str, float]:
    """Bind a positional weight list to an explicit column list."""
    if len(values) != len(columns):
        raise ValueError(f"{len(values)} weights given for {len(columns)} columns")
    return dict(zip(columns, map(float, values)))


@dataclass(frozen=True)
class Bounds:
    """Inclusive limits on one attribute; None switches a side off."""

    column: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Params:
    regimes: Sequence[str]
    bounds: Sequence[Bounds] = ()
    required_attributes: Sequence[str] | None = None  # default: the bounded columns
    top_n: int = TOP_N
    weights: Mapping[str, float] | None = None  # default: default_weights(regimes)
    min_series: int | None = None  # default: one for each regime
    min_fall_points: int = MIN_FALL_POINTS
    max_factors_lower: int = MAX_FACTORS_LOWER
    max_factors_higher: int = MAX_FACTORS_HIGHER
    max_factors_joint: int = MAX_FACTORS_JOINT
    on_constant: str = "error"
    methods: Sequence[str] = field(default=("factor", "cv", "cv_factor"))

    @property
    def columns(self) -> list[str]:
        return feature_columns(self.regimes)

    @property
    def weight_map(self) -> dict[str, float]:
        return dict(self.weights) if self.weights is not None else default_weights(self.regimes)

    @property
    def attribute_columns(self) -> list[str]:
        if self.required_attributes is not None:
            return list(self.required_attributes)
        return [b.column for b in self.bounds]
