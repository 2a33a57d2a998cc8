"""Distribution transforms of numeric columns: power families, clipping, binning, ranks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.base import Fitted, Step
from tabprep.functions.columns import (
    as_double, col, nan_to_null, numeric_columns, replace_columns, small_table)
from tabprep.functions.likelihood import fit_lambdas
from tabprep.functions.math import (
    box_cox, box_cox_inverse, clip, normal_quantile, yeo_johnson, yeo_johnson_inverse)
from tabprep.functions.moments import adjusted_skew, profile
from tabprep.functions.order_stats import order_statistics, quantiles

# Accepted method names, each with its other spellings.
METHODS = {
    "log": ("log", "log_transform"),
    "box_cox": ("box_cox", "box-cox", "boxcox"),
    "yeo_johnson": ("yeo_johnson", "yeo-johnson", "yeojohnson"),
    "sqrt": ("sqrt", "square_root", "square-root"),
    "cbrt": ("cbrt", "cube_root", "cube-root"),
    "inverse": ("inverse", "reciprocal"),
    "power": ("power",),
    "winsorize": ("winsorize", "winsorizing"),
    "clip": ("clip", "clipping"),
    "add_constant": ("add_constant", "constant_addition", "constant-addition"),
    "bin": ("bin", "binning", "data_binning", "data-binning"),
    "quantile": ("quantile", "quantile_transform", "quantile-transform"),
    "zscore": ("zscore", "z_score", "z-score"),
}
ZEROS = ("offset", "ignore", "drop")

LANDMARKS = 1_000
#: probabilities are kept this far from 0 and 1 before the normal quantile
EDGE = 1e-7


def method_name(text: str) -> str:
    for name, spellings in METHODS.items():
        if text.lower() in spellings:
            return name
    raise ValueError(f"no transform called {text!r}; there are {list(METHODS)}")


def skewness_report(df: DataFrame, columns: Sequence[str] | None = None,
                    lambdas: Mapping[str, float] | None = None,
                    transformed: Sequence[str] = ()) -> DataFrame:
    """Adjusted skewness per column, strongest first, with the fitted lambda if there is one."""
    names = numeric_columns(df) if columns is None else list(columns)
    row = df.agg(*[adjusted_skew(as_double(c)).alias(f"s{i}") for i, c in enumerate(names)])
    items = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("skewness"),
                      F.lit(int(c in transformed)).alias("transformed"),
                      F.lit((lambdas or {}).get(c)).cast("double").alias("lambda"))
             for i, c in enumerate(names)]
    return row.select(F.inline(F.array(*items))).orderBy(F.abs("skewness").desc(), "column")


def skewness_advice(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Band of the skewness and the transform to try."""
    size = F.abs("skewness")
    band = (F.when(size > 1, "highly skewed").when(size > 0.5, "moderately skewed")
            .otherwise("approximately symmetric"))
    advice = (F.when(size > 1, "log, Box-Cox or Yeo-Johnson").when(size > 0.5, "square root or log")
              .otherwise("none needed"))
    return (skewness_report(df, columns).select("column", "skewness", band.alias("band"),
                                                advice.alias("suggestion")))


def skew_improvement(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute skewness before and after, and the relative gain in percent."""
    old = skewness_report(before, columns).select("column", F.col("skewness").alias("skew_before"))
    new = skewness_report(after, columns).select("column", F.col("skewness").alias("skew_after"))
    b, a = F.abs("skew_before"), F.abs("skew_after")
    gain = F.when(b > 0, (b - a) / b * 100.0).otherwise(0.0)
    # a report has one row per column
    return old.join(F.broadcast(new), "column").withColumn("improvement_pct", gain)


@dataclass
class FittedDistribution(Fitted):
    """Learned numbers per column for one transform, applied in place. NULL stays NULL."""

    method: str
    params: dict = field(default_factory=dict)
    handle_zeros: str = "offset"
    offset: float = 1.0
    power_value: float = 2.0
    skewness: dict = field(default_factory=dict)

    def _shifted(self, c: Column) -> Column:
        if self.handle_zeros == "offset":
            return c + F.lit(self.offset)
        return F.when(c > 0, c) if self.handle_zeros == "drop" else c

    def expression(self, c: str) -> Column:
        x, p = as_double(c), self.params[c]
        match self.method:
            case "log":
                return F.log(self._shifted(x))
            case "box_cox":
                return box_cox(self._shifted(x), p["lambda"])
            case "yeo_johnson":
                return yeo_johnson(x, p["lambda"])
            case "sqrt":
                return nan_to_null(F.sqrt(x))
            case "cbrt":
                return F.cbrt(x)
            case "inverse":
                return F.try_divide(F.lit(1.0), x + F.lit(self.offset))
            case "power":
                return nan_to_null(F.pow(x, F.lit(self.power_value)))
            case "winsorize" | "clip":
                return clip(x, p["lo"], p["hi"])
            case "add_constant":
                return x + F.lit(self.offset)
            case "bin":
                above = F.lit(0.0)
                for e in p["edges"][1:-1]:
                    above = above + (x > F.lit(e)).cast("double")
                return above
            case "zscore":
                return (x - F.lit(p["mean"])) / F.lit(p["std"])
        raise ValueError(self.method)

    def transform(self, df: DataFrame) -> DataFrame:
        names = [c for c in self.params if c in df.columns]
        if self.method == "quantile":
            for c in names:
                df = self._to_normal(df, c)
            return df
        return replace_columns(df, {c: self.expression(c) for c in names})

    def _to_normal(self, df: DataFrame, c: str) -> DataFrame:
        """Interpolate between landmark quantiles. The landmark below a value is found by binary
        search and brings its numbers along from a table of at most LANDMARKS rows."""
        p = self.params[c]
        v, lo, hi = p["values"], p["first"], p["last"]
        x = as_double(c)
        named = df.withColumn("__x", F.coalesce(x, F.lit(math.nan)))
        if len(v) < 2:
            placed = named.withColumn("__p", F.lit(0.0))
        else:
            marks = small_table(df.sparkSession, {
                "__b": pa.array([float(i) for i in range(len(v))], pa.float64()),
                "__v0": pa.array(v, pa.float64()), "__p0": pa.array(hi, pa.float64()),
                "__v1": pa.array([*v[1:], v[-1]], pa.float64()),
                "__p1": pa.array([*lo[1:], 1.0], pa.float64()),
                # a landmark that stands for several ranks maps to their middle
                "__mid": pa.array([(a + b) / 2 for a, b in zip(lo, hi, strict=True)], pa.float64())})
            cut = Bucketizer(splits=[-math.inf, *v[1:], math.inf], inputCol="__x",
                             outputCol="__b", handleInvalid="keep")
            step = F.try_divide(x - F.col("__v0"), F.col("__v1") - F.col("__v0"))
            between = F.col("__p0") + step * (F.col("__p1") - F.col("__p0"))
            placed = cut.transform(named).join(F.broadcast(marks), "__b", "left").withColumn(
                "__p", F.when(x <= v[0], 0.0).when(x >= v[-1], 1.0)
                .when(x == F.col("__v0"), F.col("__mid")).otherwise(between))
        inner = placed.withColumn("__p", F.least(F.greatest("__p", F.lit(EDGE)), F.lit(1 - EDGE)))
        new = F.when(col(c).isNotNull(), normal_quantile(F.col("__p")))
        return inner.select(*[new.alias(n) if n == c else col(n) for n in df.columns])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in [c for c in self.params if c in df.columns]:
            y = as_double(c)
            if self.method == "log":
                new[c] = F.exp(y) - F.lit(self.offset if self.handle_zeros == "offset" else 0.0)
            elif self.method == "box_cox":
                back = box_cox_inverse(y, self.params[c]["lambda"])
                new[c] = back - F.lit(self.offset if self.handle_zeros == "offset" else 0.0)
            elif self.method == "yeo_johnson":
                new[c] = yeo_johnson_inverse(y, self.params[c]["lambda"])
        return replace_columns(df, new)


@dataclass
class DistributionTransformer(Step):
    """One of METHODS on the chosen numeric columns, with all statistics learned in ``fit``."""

    method: str = "log"
    columns: Sequence[str] | None = None
    handle_zeros: str = "offset"
    offset: float = 1.0
    min_skew_threshold: float = 0.5
    skew_gate: bool = False
    power_value: float = 2.0
    limits: float = 0.01
    bins: int = 4

    def __post_init__(self):
        self.method = method_name(self.method)
        self.handle_zeros = self.handle_zeros.lower()
        if self.handle_zeros not in ZEROS:
            raise ValueError(f"zeros: choose from {ZEROS}")
        if self.offset < 0 or self.min_skew_threshold < 0:
            raise ValueError("an offset or a skewness limit below 0 has no meaning")

    def fit(self, df: DataFrame, target: str | None = None) -> FittedDistribution:
        numbers = numeric_columns(df, [target] if target else [])
        names = numbers if self.columns is None else [c for c in self.columns if c in numbers]
        seen = profile(df, names, ["n", "min", "max", "mean", "std", "skew"])
        names = [c for c in names if seen[c]["n"]]
        if self.skew_gate:
            names = [c for c in names if seen[c]["min"] != seen[c]["max"]
                     and abs(seen[c]["skew"] or 0.0) >= self.min_skew_threshold]
        params = getattr(self, f"_fit_{self.method}", self._fit_nothing)(df, names, seen)
        return FittedDistribution(self.method, params, self.handle_zeros, self.offset,
                                  self.power_value, {c: seen[c]["skew"] for c in seen})

    def _fit_nothing(self, df, names, seen) -> dict:
        return {c: {} for c in names}

    def _fit_zscore(self, df, names, seen) -> dict:
        return {c: {"mean": seen[c]["mean"], "std": seen[c]["std"]} for c in names if seen[c]["std"]}

    def _fit_clip(self, df, names, seen) -> dict:
        return {c: {"lo": q[0], "hi": q[1]}
                for c, q in quantiles(df, names, [self.limits, 1 - self.limits], seen).items()}

    def _fit_winsorize(self, df, names, seen) -> dict:
        known = {(c, None): (seen[c]["n"], seen[c]["min"], seen[c]["max"]) for c in names}
        ends = {c: (int(self.limits * seen[c]["n"]), seen[c]["n"] - int(self.limits * seen[c]["n"]) - 1)
                for c in names}
        at = order_statistics(df, names, lambda key, n: ends[key[0]], known=known)
        return {c: {"lo": at[c, None][ends[c][0]], "hi": at[c, None][ends[c][1]]} for c in names}

    def _fit_bin(self, df, names, seen) -> dict:
        probs = [i / self.bins for i in range(self.bins + 1)]
        return {c: {"edges": sorted(set(q))} for c, q in quantiles(df, names, probs, seen).items()}

    def _fit_quantile(self, df, names, seen) -> dict:
        marks = {c: min(LANDMARKS, seen[c]["n"]) for c in names}
        probs = {c: [i / (m - 1) for i in range(m)] if m > 1 else [0.5] for c, m in marks.items()}
        # columns with equally many landmarks, which are nearly always all, share one search
        found = {}
        for m in sorted(set(marks.values())):
            some = [c for c in names if marks[c] == m]
            found |= quantiles(df, some, probs[some[0]], {c: seen[c] for c in some})
        params = {}
        for c in names:
            values, at = found[c], probs[c]
            distinct = sorted(set(values))
            ends = [(np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right") - 1)
                    for v in distinct]
            params[c] = {"values": distinct, "first": [at[int(i)] for i, _ in ends],
                         "last": [at[int(j)] for _, j in ends]}
        return params

    def _fit_box_cox(self, df, names, seen) -> dict:
        shift = self.offset if self.handle_zeros == "offset" else 0.0
        # a column that stays non-positive after the offset is left as it is
        usable = [c for c in names if self.handle_zeros == "drop" or seen[c]["min"] + shift > 0]
        exprs = {c: ("box_cox", F.when(as_double(c) + F.lit(shift) > 0, as_double(c) + F.lit(shift)))
                 for c in usable}
        return {c: {"lambda": v} for c, v in fit_lambdas(df, exprs).items()}

    def _fit_yeo_johnson(self, df, names, seen) -> dict:
        found = fit_lambdas(df, {c: ("yeo_johnson", as_double(c)) for c in names})
        return {c: {"lambda": v} for c, v in found.items()}


@dataclass
class FittedLogSelection(Fitted):
    """Columns to replace by ``log1p`` under the name ``{column}_log``."""

    columns: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out: list[Column] = []
        for c in df.columns:
            if c in self.columns:
                out.append(F.log1p(as_double(c)).alias(f"{c}_log"))
            elif not (c.endswith("_log") and c[:-4] in self.columns and c[:-4] in df.columns):
                out.append(col(c))
        return df.select(*out)


@dataclass
class LogSelector(Step):
    """log1p for columns without negatives whose mean exceeds the median and whose std is large."""

    min_std: float = 1.0
    exclude: Sequence[str] = ()

    def fit(self, df: DataFrame, target: str | None = None) -> FittedLogSelection:
        names = numeric_columns(df, [*self.exclude, *([target] if target else [])])
        seen = profile(df, names, ["n", "min", "max", "mean", "std"])
        # the median is looked up only where the cheaper conditions hold
        names = [c for c in names if seen[c]["n"] and seen[c]["min"] >= 0
                 and (seen[c]["std"] or 0.0) > self.min_std]
        middle = quantiles(df, names, [0.5], seen)
        return FittedLogSelection([c for c in names if seen[c]["mean"] > middle[c][0]])

