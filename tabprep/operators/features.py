"""Feature creation, extraction and selection."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.base import Fitted, Step
from tabprep.functions.columns import (
    add_all, any_of, as_double, col, is_fractional, nan_to_null, number, numeric_columns, replace_columns, small_table)
from tabprep.functions.entropy import mutual_information_with_classes, mutual_information_with_numbers
from tabprep.functions.moments import correlation, profile
from tabprep.functions.order_stats import quantiles
from tabprep.functions.pairs import covariance
from tabprep.sources.storage import stored

Rule = Callable[[list[Column]], Column]


def row_sum(xs: Sequence[Column]) -> Column:
    """Sum of the non-null values; 0 if there is none."""
    return add_all([F.coalesce(x, F.lit(0.0)) for x in xs])


def row_mean(xs: Sequence[Column]) -> Column:
    return F.try_divide(row_sum(xs), add_all([x.isNotNull().cast("double") for x in xs]))


def row_product(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a * b, [F.coalesce(x, F.lit(1.0)) for x in xs])


def row_log_sum(xs: Sequence[Column]) -> Column:
    return nan_to_null(F.log1p(row_sum(xs)))


def row_max(xs: Sequence[Column]) -> Column:
    return F.greatest(*xs)


def row_min(xs: Sequence[Column]) -> Column:
    return F.least(*xs)


def default_rules() -> dict[str, Rule]:
    return {"sum_features": row_sum, "mean_features": row_mean, "product_features": row_product,
            "log_sum": row_log_sum, "max_feature": row_max, "min_feature": row_min}


@dataclass
class FeatureCreator(Step):
    """New columns from rules over all numeric columns; a rule maps Columns to a Column.

    As a step from settings, ``rules`` may be the names of standard rules.
    """

    rules: dict[str, Rule] | Sequence[str] = field(default_factory=default_rules)
    columns: Sequence[str] | None = None

    def __post_init__(self):
        if not isinstance(self.rules, Mapping):
            standard = default_rules()
            self.rules = {name: standard[name] for name in self.rules}

    def add_rule(self, name: str, rule: Rule) -> FeatureCreator:
        if not callable(rule):
            raise ValueError(f"rule {name!r} is no function of Columns")
        self.rules[name] = rule
        return self

    def fit(self, df: DataFrame, target: str | None = None) -> FittedCreator:
        names = list(self.columns) if self.columns is not None else numeric_columns(
            df, [target] if target else [])
        return FittedCreator(names, self.rules if len(names) >= 2 else {})


@dataclass
class FittedCreator(Fitted):
    columns: list
    rules: dict

    def transform(self, df: DataFrame) -> DataFrame:
        xs = [as_double(c) for c in self.columns]
        return replace_columns(df, {name: rule(xs) for name, rule in self.rules.items()})

    def to_dict(self) -> dict:
        standard = default_rules()
        custom = [n for n, r in self.rules.items() if standard.get(n) is not r]
        if custom:
            raise TypeError(f"rules {custom} are code and cannot be saved as JSON")
        return {"step": "FittedCreator", "params": {"columns": self.columns, "rules": list(self.rules)}}

    @classmethod
    def restore(cls, params: dict) -> FittedCreator:
        return cls(params["columns"], {n: default_rules()[n] for n in params["rules"]})


def synthetic_sum(df: DataFrame, columns: Sequence[str] | None = None,
                  name: str = "synthetic_sum") -> DataFrame:
    names = numeric_columns(df) if columns is None else columns
    return df.withColumn(name, row_sum([as_double(c) for c in names]))


@dataclass
class FittedPCA(Fitted):
    """Centred projection on the principal axes."""

    columns: list
    means: list
    axes: list
    explained: list
    prefix: str = "PC_"
    append: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        xs = [as_double(c) for c in self.columns]
        if self.append:
            xs = [F.coalesce(x, F.lit(0.0)) for x in xs]
        centred = [x - F.lit(m) for x, m in zip(xs, self.means, strict=True)]
        parts = [add_all([x * F.lit(w) for x, w in zip(centred, axis, strict=True)])
                 .alias(f"{self.prefix}{i + 1}") for i, axis in enumerate(self.axes)]
        if self.append:
            return df.select("*", *parts)
        return df.select(*parts, *[col(c) for c in df.columns if c not in self.columns])

    def explained_variance(self, df: DataFrame) -> DataFrame:
        return small_table(df.sparkSession, {
            "component": pa.array([f"{self.prefix}{i + 1}" for i in range(len(self.axes))], pa.string()),
            "explained_ratio": pa.array(self.explained[:len(self.axes)], pa.float64())})


@dataclass
class PrincipalComponents(Step):
    """Axes of the covariance matrix, built in one aggregation. ``n_components`` is None (all), a
    number, or the share of variance to explain; the largest loading of an axis is positive."""

    n_components: int | float | None = None
    columns: Sequence[str] | None = None
    append: bool = False

    def fit(self, df: DataFrame, target: str | None = None) -> FittedPCA:
        names = list(self.columns) if self.columns is not None else numeric_columns(
            df, [target] if target else [])
        if not names:
            raise ValueError("principal axes need a numeric column")
        complete = df.where(~any_of([col(c).isNull() for c in names]))
        means, cov = covariance(complete, names)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")
        values, axes = np.clip(values[order], 0, None), vectors[:, order].T
        share = values / values.sum() if values.sum() else np.zeros(len(values))
        n = self.n_components
        if n is None:
            keep = len(names)
        elif isinstance(n, float) and 0 < n < 1:
            keep = min(len(names), int(np.searchsorted(share.cumsum(), n, side="right")) + 1)
        else:
            keep = min(int(n), len(names))
        axes = [(a if a[np.argmax(np.abs(a))] >= 0 else -a).tolist() for a in axes[:keep]]
        return FittedPCA(names, means.tolist(), axes, share.tolist(),
                         "PC" if self.append else "PC_", self.append)


@dataclass
class FittedSelector(Fitted):
    """Selected numeric columns; non-numeric columns always stay, after them."""

    selected: list
    scores: dict
    numeric: list

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in self.selected if c in df.columns]
        others = [c for c in df.columns if c not in self.numeric]
        return df.select(*[col(c) for c in [*kept, *others]])

    def report(self, df: DataFrame) -> DataFrame:
        return small_table(df.sparkSession, {
            "feature": pa.array(list(self.scores), pa.string()),
            "score": pa.array(list(self.scores.values()), pa.float64()),
            "selected": pa.array([int(c in self.selected) for c in self.scores], pa.int32())})


def anova_f(df: DataFrame, columns: Sequence[str], target: str) -> dict[str, float | None]:
    """F statistic of each column over the classes of the target: one row per class, stored, then sums over the classes.

    There may be any number of classes; the driver sees a few sums per column.
    """
    classes = stored(df.where(col(target).isNotNull()).groupBy(col(target).alias("c")).agg(
        *[f(number(c)).alias(f"{m}{i}") for i, c in enumerate(columns)
          for m, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]).drop("c"), "classes")
    sums = classes.agg(*[x for i in range(len(columns)) for x in (
        F.sum(f"n{i}"), F.count_if(F.col(f"n{i}") > 0), F.sum(F.col(f"n{i}") * F.col(f"m{i}")),
        F.sum(F.col(f"n{i}") * F.col(f"v{i}")))]).first()
    whole = [(float(sums[4 * i] or 0), sums[4 * i + 1], sums[4 * i + 2], sums[4 * i + 3] or 0.0) for i in range(len(columns))]
    spread = classes.agg(*[F.sum(F.col(f"n{i}") * F.pow(F.col(f"m{i}") - F.lit((t or 0.0) / n if n else 0.0), 2))
                           for i, (n, _, t, _) in enumerate(whole)]).first()
    out: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        (total, k, _, within), between = whole[i], spread[i]
        out[c] = (between / (k - 1)) / (within / (total - k)) if k > 1 and within > 0 else None
    return out


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> dict[str, float]:
    """Mutual information (nats) by nearest neighbours; a fractional target is continuous, any other holds classes."""
    if is_fractional(df.schema[target].dataType):
        return mutual_information_with_numbers(df, columns, target, k)
    return mutual_information_with_classes(df, columns, target, k)


def binned_mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> dict[str, float]:
    """Mutual information (nats) between each column, cut into quantile bins, and the values of the target."""
    edges = quantiles(df, columns, [i / bins for i in range(1, bins)])
    cells = []
    for i, c in enumerate(columns):
        above = F.lit(0)
        for e in sorted(set(edges[c])):
            above = above + (number(c) > F.lit(e)).cast("int")
        cells.append(F.struct(F.lit(i).alias("f"), above.alias("b")))
    counts = stored(df.select(col(target).alias("y"), F.inline(F.array(*cells)))
                    .where(F.col("b").isNotNull() & F.col("y").isNotNull())
                    .groupBy("f", "b", "y").agg(F.count("*").alias("n")), "joint-counts")
    by_bin = counts.groupBy("f", "b").agg(F.sum("n").alias("nb"))  # columns x bins rows
    by_value = counts.groupBy("f", "y").agg(F.sum("n").alias("ny"))
    total = counts.groupBy("f").agg(F.sum("n").alias("t"))
    joined = counts.join(by_value, ["f", "y"]).join(F.broadcast(by_bin), ["f", "b"]).join(F.broadcast(total), "f")
    part = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))
    found = {r["f"]: r["mi"] for r in joined.groupBy("f").agg(F.sum(part).alias("mi")).collect()}
    return {c: float(found.get(i, 0.0)) for i, c in enumerate(columns)}


ScoreFunction = Callable[[DataFrame, Sequence[str], str], Mapping[str, float | None]]


@dataclass
class FeatureSelector(Step):
    """Keep numeric columns by population variance, by a score against the target, or by
    absolute correlation with the target."""

    strategy: str = "univariate"
    threshold: float = 0.0
    k: int | str = "all"
    score_func: ScoreFunction = anova_f
    columns: Sequence[str] | None = None

    def fit(self, df: DataFrame, target: str | None = None) -> FittedSelector:
        names = list(self.columns) if self.columns is not None else numeric_columns(
            df, [target] if target else [])
        if not names:
            raise ValueError("there is no numeric column to select from")
        if self.strategy == "variance":
            scores = {c: m["var_pop"] for c, m in profile(df, names, ["var_pop"]).items()}
            chosen = [c for c in names if (scores[c] or 0.0) > self.threshold]
            return FittedSelector(chosen, scores, names)
        if self.strategy not in ("univariate", "correlation"):
            raise ValueError(f"no selection by {self.strategy!r}")
        if target is None:
            raise ValueError(f"selection by {self.strategy} needs a target")
        if self.strategy == "correlation":
            row = df.agg(*[F.abs(correlation(as_double(c), as_double(target))) for c in names]).first()
            scores = dict(zip(names, row, strict=True))
            return FittedSelector([c for c in names if (scores[c] or 0.0) > self.threshold], scores, names)
        scores = dict(self.score_func(df, names, target))
        ranked = sorted(names, key=lambda c: -(scores[c] if scores[c] is not None else -math.inf))
        best = set(ranked if self.k == "all" else ranked[:int(self.k)])
        return FittedSelector([c for c in names if c in best], scores, names)


def polynomial_features(df: DataFrame, columns: Sequence[str] | None = None,
                        degree: int = 2) -> DataFrame:
    """Append all products with repetition up to the degree, named like ``a^2`` and ``a b``."""
    names = numeric_columns(df) if columns is None else list(columns)
    new = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(names, d):
            powers = Counter(combo)
            name = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())
            if name not in df.columns:
                new[name] = reduce(lambda a, b: a * b, [as_double(c) for c in combo])
    return replace_columns(df, new)


def date_parts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``{c}_day``, ``{c}_month`` and ``{c}_weekday`` (Monday is 0)."""
    new = {}
    for c in columns:
        new |= {f"{c}_day": F.dayofmonth(col(c)), f"{c}_month": F.month(col(c)),
                f"{c}_weekday": F.weekday(col(c))}
    return replace_columns(df, new)


@dataclass
class FittedBins(Fitted):
    """Right-closed bins; outside values give NULL."""

    edges: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, edges in self.edges.items():
            x = as_double(c)
            label = F.lit(0)
            for e in edges[1:-1]:
                label = label + (x > F.lit(e)).cast("int")
            new[f"{c}_bin"] = F.when((x > F.lit(edges[0])) & (x <= F.lit(edges[-1])), label)
        return replace_columns(df, new)


@dataclass
class EqualWidthBinner(Step):
    """Bins per column: a number of equal-width bins, or explicit edges."""

    bins: Mapping[str, int | Sequence[float]]

    def fit(self, df: DataFrame, target: str | None = None) -> FittedBins:
        counted = [c for c, b in self.bins.items() if isinstance(b, int)]
        seen = profile(df, counted, ["min", "max"])
        edges = {}
        for c, b in self.bins.items():
            if not isinstance(b, int):
                edges[c] = [float(e) for e in b]
                continue
            lo, hi = seen[c]["min"], seen[c]["max"]
            if lo == hi:
                reach = 0.001 * abs(lo) if lo else 0.001
                edges[c] = [lo - reach + i * 2 * reach / b for i in range(b + 1)]
                continue
            edges[c] = [lo + i * (hi - lo) / b for i in range(b)] + [hi]
            # the lowest value belongs to the first bin
            edges[c][0] = lo - 0.001 * (hi - lo)
        return FittedBins(edges)
