"""Scaling of numeric columns, with inverse."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.base import Fitted, Step
from tabprep.functions.columns import as_double, col, numeric_columns, replace_columns
from tabprep.functions.moments import profile
from tabprep.functions.order_stats import quantiles

METHODS = ("standard", "minmax", "robust")


@dataclass
class FittedScaler(Fitted):
    """``(x - center) / scale`` per column."""

    centers: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    in_place: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.centers:
            if c in df.columns:
                name = c if self.in_place else f"{c}_scaled"
                new[name] = (as_double(c) - F.lit(self.centers[c])) / F.lit(self.scales[c])
        return replace_columns(df, new)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.centers:
            source = c if self.in_place else f"{c}_scaled"
            if source in df.columns:
                back = col(source) * F.lit(self.scales[c]) + F.lit(self.centers[c])
                new[c if self.in_place else f"{c}_original"] = back
        return replace_columns(df, new)


@dataclass
class FeatureScaler(Step):
    """standard (population std), minmax, or robust (median and interquartile range).

    A spread of 0 counts as 1. ``min_std`` skips columns whose sample std is not above it.
    """

    method: str = "standard"
    columns: Sequence[str] | None = None
    in_place: bool = False
    min_std: float | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"no scaling called {self.method!r}; there are {METHODS}")

    def fit(self, df: DataFrame, target: str | None = None) -> FittedScaler:
        numbers = numeric_columns(df, [target] if target else [])
        names = numbers if self.columns is None else [c for c in self.columns if c in numbers]
        seen = profile(df, names, ["n", "mean", "std", "std_pop", "min", "max"])
        names = [c for c in names if seen[c]["n"]]
        if self.min_std is not None:
            names = [c for c in names if (seen[c]["std"] or 0.0) > self.min_std]
        if self.method == "standard":
            pairs = {c: (seen[c]["mean"], seen[c]["std_pop"]) for c in names}
        elif self.method == "minmax":
            pairs = {c: (seen[c]["min"], seen[c]["max"] - seen[c]["min"]) for c in names}
        else:
            pairs = {c: (q[1], q[2] - q[0])
                     for c, q in quantiles(df, names, [0.25, 0.5, 0.75], seen).items()}
        return FittedScaler({c: float(p[0]) for c, p in pairs.items()},
                            {c: float(p[1]) or 1.0 for c, p in pairs.items()}, self.in_place)
