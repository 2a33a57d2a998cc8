"""Steps that decide per column what to do, from a profile of the table. Each returns the new table
and a report with the decisions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.base import Fitted, Step
from tabprep.functions.columns import (
    any_of, as_double, col, flag, number, numeric_columns, replace_columns, small_table)
from tabprep.functions.likelihood import fit_lambdas
from tabprep.functions.math import box_cox, clip, normality_p, outside, yeo_johnson
from tabprep.functions.moments import profile
from tabprep.functions.order_stats import quantiles
from tabprep.functions.pairs import correlations, gram
from tabprep.operators.collinear import FittedSelection, vif_from_gram
from tabprep.operators.encoding import distinct_counts, encode_dummies, fit_frequency
from tabprep.operators.features import EqualWidthBinner, date_parts, polynomial_features
from tabprep.operators.missing import (
    RegressionImputer, fill_in_time, impute_knn, impute_knn_text, modes, null_counts)
from tabprep.operators.outliers import IsolationForest
from tabprep.operators.scaling import FittedScaler
from tabprep.sources.storage import stored


def report(df: DataFrame, columns: Mapping[str, str], rows: Sequence[Sequence]) -> DataFrame:
    """A decision table; ``columns`` maps names to arrow type names."""
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    return small_table(df.sparkSession, {
        name: pa.array([r[i] for r in rows], kinds[kind])
        for i, (name, kind) in enumerate(columns.items())})


# --- missing values -------------------------------------------------------------------------

IMPUTE_REPORT = {"column": "string", "missing_pct": "double", "method": "string"}


class _Gap(NamedTuple):
    """What decides how the gaps of a column are filled: percent of rows, kind, skewness, and whether it must stay."""

    share: float
    numeric: bool
    skew: float
    critical: bool


#: The first row that holds names the fill. The shares 5 and 30 and the skewness 1 are the specification.
_FILLS: tuple[tuple[str, Callable[[_Gap], bool]], ...] = (
    ("most frequent", lambda g: g.share < 5 and not g.numeric),
    ("mean", lambda g: g.share < 5 and abs(g.skew) < 1),
    ("median", lambda g: g.share < 5),
    ("neighbours", lambda g: g.share <= 30 and g.numeric),
    ("vote of neighbours", lambda g: g.share <= 30),
    ("regression", lambda g: g.critical and g.numeric),
    ("dropped", lambda g: True),
)


def impute_auto(df: DataFrame, key: str, is_time_series: bool = False, time_col: str | None = None,
                critical_cols: Sequence[str] = (), corr_threshold: float = 0.5, k: int = 5,
                text_features: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill every column with gaps by the rule of ``_FILLS`` that its share of gaps, kind and skewness meet; the table and
    a report. In a time series all gaps are filled forward, then backward.

    Columns are handled in their order, and each sees the fills before it: neighbours fill all numeric columns at once, a
    regression is fitted on what is filled by then. Searches are stored, so that no later step repeats them.
    """
    names = [c for c in df.columns if c != key]
    rows, nulls = null_counts(df, names)
    share = {c: 100.0 * nulls[c] / rows if rows else 0.0 for c in names}
    gaps = [c for c in names if nulls[c]]
    if is_time_series:
        return fill_in_time(df, time_col, key, gaps), report(df, IMPUTE_REPORT, [(c, share[c], "along time") for c in gaps])
    numbers = numeric_columns(df, [key])
    seen = profile(df, [c for c in gaps if c in numbers], ["n", "min", "max", "mean", "skew_pop"])
    chosen = {}
    for c in gaps:
        gap = _Gap(share[c], c in numbers, (seen[c]["skew_pop"] or 0.0) if c in seen else 0.0, c in critical_cols)
        chosen[c] = next(name for name, holds in _FILLS if holds(gap))
    middle = quantiles(df, [c for c in gaps if chosen[c] == "median"], [0.5], seen)
    common = modes(df, [c for c in gaps if chosen[c] == "most frequent"])
    single = {"mean": lambda c: seen[c]["mean"], "median": lambda c: middle[c][0], "most frequent": lambda c: common[c]}
    out, lines = df, []
    for c in gaps:
        how = chosen[c]
        if how in single:
            now = number(c) if c in numbers else col(c)
            out = replace_columns(out, {c: F.coalesce(now, F.lit(single[how](c)))})
        elif how == "neighbours":
            left = [x for x in numbers if x in out.columns]
            out = stored(impute_knn(out, key, left, left, k), "imputed")
        elif how == "vote of neighbours":
            features = [x for x in (text_features or names) if x != c and x in out.columns and x not in numbers]
            out = stored(impute_knn_text(out, key, c, features, k), "imputed")
        elif how == "regression":
            others = [x for x in numbers if x != c and x in out.columns]
            fitted = RegressionImputer(c, corr_threshold, others).fit(out)
            how = f"regression on {', '.join(fitted.predictors)}" if fitted.predictors else "dropped"
            out = fitted.transform(out)
        if how == "dropped":
            out = out.drop(c)
        lines.append((c, share[c], how))
    return out, report(df, IMPUTE_REPORT, lines)


# --- outliers -------------------------------------------------------------------------------

OUTLIER_REPORT = {"feature": "string", "outliers": "bigint", "pct_outliers": "double",
                  "detection": "string", "handling": "string"}


@dataclass
class AutoOutliers:
    """Result of ``outlier_auto``: the cleaned table, the report, and a flag table on the original
    values (key and one 0/1 column per feature)."""

    cleaned: DataFrame
    report: DataFrame
    flags: DataFrame


class _Spread(NamedTuple):
    """What decides about the outliers of a column."""

    column: str
    n: int
    mean: float
    std: float
    skew: float
    p1: float
    q1: float
    q3: float
    p99: float

    @property
    def x(self) -> Column:
        return as_double(self.column)

    @property
    def clipped(self) -> Column:
        return clip(self.x, self.p1, self.p99)


def _forest_mark(c: str) -> str:
    return f"__forest_{c}"


#: name: (where it applies, which rows it flags). Fixed values of the specification: 1.5 quartile ranges, 3 deviations
#: where the skewness is below 1, and a forest from 51 values on.
_DETECTORS: dict[str, tuple[Callable[[_Spread], bool], Callable[[_Spread], Column]]] = {
    "quartiles": (lambda s: True, lambda s: outside(s.x, s.q1 - 1.5 * (s.q3 - s.q1), s.q3 + 1.5 * (s.q3 - s.q1))),
    "deviations": (lambda s: abs(s.skew) < 1,
                   lambda s: F.abs((s.x - F.lit(s.mean)) / F.lit(s.std)) > 3 if s.std else F.lit(False)),
    "forest": (lambda s: s.n > 50, lambda s: col(_forest_mark(s.column)) == 1),
}
#: The first row that holds for the percentage of outliers says what happens: (name, condition, new values; None: the rows
#: go). Fixed values of the specification: 5 and 15 percent, skewness 1.
_TREATMENTS: tuple[tuple[str, Callable[[float, _Spread], bool], Callable[[_Spread, DataFrame], Column] | None], ...] = (
    ("rows removed", lambda pct, s: pct < 5, None),
    ("clipped, log1p", lambda pct, s: pct <= 15 and s.skew > 1, lambda s, kept: F.when(s.clipped > -1, F.log1p(s.clipped))),
    ("clipped", lambda pct, s: pct <= 15, lambda s, kept: s.clipped),
    ("scaled by quartiles", lambda pct, s: True, lambda s, kept: _by_quartiles(s, kept)),
)


def _by_quartiles(s: _Spread, kept: DataFrame) -> Column:
    q1, q2, q3 = quantiles(kept, [s.column], [0.25, 0.5, 0.75])[s.column]
    return (s.x - F.lit(q2)) / F.lit((q3 - q1) or 1.0)


def outlier_auto(df: DataFrame, key: str, columns: Sequence[str] | None = None, forest: bool = True,
                 seed: int = 42) -> AutoOutliers:
    """Flag the values of each column by all ``_DETECTORS`` that apply to it, then treat the column by the first of
    ``_TREATMENTS`` that its share of outliers meets. Scaling looks at the rows that the columns before it left."""
    names = list(columns) if columns is not None else numeric_columns(df, [key])
    seen = profile(df, names, ["n", "min", "max", "mean", "std_pop", "skew"])
    at = quantiles(df, [c for c in names if seen[c]["n"]], [0.01, 0.25, 0.75, 0.99], seen)
    spreads = [_Spread(c, seen[c]["n"], seen[c]["mean"], seen[c]["std_pop"], seen[c]["skew"] or 0.0, *q) for c, q in at.items()]
    used = {s.column: [d for d, (applies, _) in _DETECTORS.items() if applies(s) and (forest or d != "forest")] for s in spreads}
    marked = df
    for s in spreads:
        if "forest" in used[s.column]:
            marked = IsolationForest(s.column, key, seed=seed).fit(df).flagged(marked, _forest_mark(s.column))
    out = {s.column: f"__out_{s.column}" for s in spreads}
    marked = marked.select("*", *[
        flag(any_of([F.coalesce(_DETECTORS[d][1](s), F.lit(False)) for d in used[s.column]])).alias(out[s.column]) for s in spreads])
    counts = marked.agg(F.lit(0), *[F.sum(col(o)) for o in out.values()]).first()[1:]
    kept, new, lines = marked, {}, []
    for s, n in zip(spreads, counts, strict=True):
        pct = 100.0 * n / s.n
        name, _, values = next(t for t in _TREATMENTS if t[1](pct, s))
        if values is None:
            kept = kept.where(col(out[s.column]) == 0)
        else:
            new[s.column] = values(s, kept)
        lines.append((s.column, int(n), round(pct, 2), " + ".join(used[s.column]), name))
    cleaned = replace_columns(kept.select(*[col(c) for c in df.columns]), new)
    flags = marked.select(col(key), *[col(o).alias(c) for c, o in out.items()])
    return AutoOutliers(cleaned, report(df, OUTLIER_REPORT, lines), flags)


# --- distribution ---------------------------------------------------------------------------

SKEW_REPORT = {"feature": "string", "skew_before": "double", "transformed": "int",
               "method": "string", "skew_after": "double"}


@dataclass
class FittedAutoTransform(Fitted):
    """Box-Cox, or Yeo-Johnson followed by standardising, for the right-skewed columns."""

    methods: dict = field(default_factory=dict)
    lines: list = field(default_factory=list)

    def expression(self, c: str) -> Column:
        m = self.methods[c]
        if m["kind"] == "box_cox":
            return box_cox(as_double(c), m["lambda"])
        return (yeo_johnson(as_double(c), m["lambda"]) - F.lit(m["mean"])) / F.lit(m["std"])

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, {c: self.expression(c) for c in self.methods if c in df.columns})

    def report(self, df: DataFrame) -> DataFrame:
        return report(df, SKEW_REPORT, self.lines)


@dataclass
class AutoTransform(Step):
    columns: Sequence[str] | None = None
    skew_limit: float = 0.75

    def fit(self, df: DataFrame, target: str | None = None) -> FittedAutoTransform:
        names = list(self.columns) if self.columns is not None else numeric_columns(
            df, [target] if target else [])
        seen = profile(df, names, ["n", "nulls", "infinite", "min", "skew_pop"])
        _no_gaps(seen)
        skewed = [c for c in names if (seen[c]["skew_pop"] or 0.0) > self.skew_limit]
        kind = {c: "box_cox" if seen[c]["min"] > 0 else "yeo_johnson" for c in skewed}
        lam = fit_lambdas(df, {c: (kind[c], as_double(c)) for c in skewed})
        shape = {"box_cox": box_cox, "yeo_johnson": yeo_johnson}
        done = {c: shape[kind[c]](as_double(c), lam[c]) for c in skewed}
        after = profile(df, done, ["mean", "std_pop", "skew_pop"])
        methods, lines = {}, []
        for c in names:
            before = round(seen[c]["skew_pop"], 3) if seen[c]["skew_pop"] is not None else None
            if c not in done:
                lines.append((c, before, 0, "none", before))
                continue
            methods[c] = {"kind": kind[c], "lambda": lam[c], "mean": after[c]["mean"],
                          "std": after[c]["std_pop"] or 1.0}
            lines.append((c, before, 1, kind[c],
                          round(after[c]["skew_pop"], 3)))
        return FittedAutoTransform(methods, lines)


def _no_gaps(seen: Mapping[str, Mapping]) -> None:
    for c, m in seen.items():
        if m["nulls"] or m["infinite"]:
            raise ValueError(f"missing or infinite values in {c}")


# --- scaling --------------------------------------------------------------------------------

SCALE_REPORT = {"feature": "string", "distribution": "string", "skewness": "double",
                "outlier_fraction": "double", "scaler": "string"}


@dataclass
class FittedAutoScaler(Fitted):
    scaler: dict = field(default_factory=dict)
    lines: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return FittedScaler(**self.scaler).transform(df)

    def report(self, df: DataFrame) -> DataFrame:
        return report(df, SCALE_REPORT, self.lines)


@dataclass
class AutoScaler(Step):
    """Robust scaling with more than 5% quartile outliers, standard if the normality test passes,
    else min-max; none for tree models."""

    model_type: str = "general"
    columns: Sequence[str] | None = None

    def fit(self, df: DataFrame, target: str | None = None) -> FittedAutoScaler:
        names = list(self.columns) if self.columns is not None else numeric_columns(
            df, [target] if target else [])
        seen = profile(df, names, ["n", "nulls", "infinite", "min", "max", "mean", "std_pop",
                                   "skew_pop", "kurt_pop"])
        _no_gaps(seen)
        at = quantiles(df, names, [0.25, 0.5, 0.75], seen)
        beyond = df.agg(*[F.count_if(outside(as_double(c), q[0] - 1.5 * (q[2] - q[0]),
                                             q[2] + 1.5 * (q[2] - q[0]))) for c, q in at.items()]).first()
        centers, scales, lines = {}, {}, []
        for c, n in zip(at, beyond, strict=True):
            m = seen[c]
            share = n / m["n"]
            p = normality_p(m["n"], m["skew_pop"], m["kurt_pop"])
            normal = p is not None and p > 0.05
            if self.model_type == "tree":
                used, pair = "none", None
            elif share > 0.05:
                used, pair = "robust", (at[c][1], at[c][2] - at[c][0])
            elif normal:
                used, pair = "standard", (m["mean"], m["std_pop"])
            else:
                used, pair = "minmax", (m["min"], m["max"] - m["min"])
            if pair is not None:
                centers[c], scales[c] = float(pair[0]), float(pair[1]) or 1.0
            lines.append((c, "normal" if normal else "skewed",
                          round(m["skew_pop"], 3) if m["skew_pop"] is not None else None,
                          round(share, 3), used))
        return FittedAutoScaler({"centers": centers, "scales": scales, "in_place": True}, lines)


# --- encoding -------------------------------------------------------------------------------

ENCODE_REPORT = {"feature": "string", "unique_values": "bigint", "encoding": "string"}


def encode_auto(df: DataFrame, columns: Sequence[str], ordered: Mapping[str, Sequence[str]] | None = None,
                threshold: int = 10) -> tuple[DataFrame, DataFrame]:
    """Ordered columns by position, few categories as dummies, many by relative frequency."""
    ordered = ordered or {}
    counts = distinct_counts(df, columns)
    out, lines = df, []
    for c in columns:
        if c in ordered:
            spot = F.array_position(F.array(*[F.lit(v) for v in ordered[c]]), col(c).cast("string"))
            out = replace_columns(out, {c: F.when(spot > 0, spot.cast("double") - 1)})
            method = "position"
        elif counts[c] <= threshold:
            out, method = encode_dummies(out, c), "dummies"
        else:
            out, method = fit_frequency(df, c).transform(out), "share"
        lines.append((c, counts[c], method))
    return out, report(df, ENCODE_REPORT, lines)


# --- collinearity ---------------------------------------------------------------------------

def collinear_auto(df: DataFrame, target: str | None = None, critical_cols: Sequence[str] = (),
                   vif_threshold: float = 10.0, corr_threshold: float = 0.9,
                   columns: Sequence[str] | None = None) -> FittedSelection:
    """Drop by inflation until the worst column is fine or critical, then one of each strongly
    correlated pair, the later one, unless either is critical."""
    numbers = numeric_columns(df, [target] if target else [])
    left = numbers if columns is None else [c for c in columns if c in numbers]
    start = list(left)
    known = df.where(~any_of([col(c).isNull() for c in left]))
    _, g = gram(known, left)
    dropped = []
    while len(left) >= 2:
        idx = [start.index(c) for c in left]
        vif = vif_from_gram(g[np.ix_(idx, idx)])
        worst = int(np.argmax(vif))
        if not vif[worst] > vif_threshold or left[worst] in critical_cols:
            break
        dropped.append({"feature": left[worst], "value": float(vif[worst]), "reason": "inflation"})
        left.pop(worst)
    if len(left) >= 2:
        size = np.abs(correlations(df, left))
        gone: set[str] = set()
        for j, c in enumerate(left):
            for i, r in enumerate(left[:j]):
                if c in gone or c in critical_cols or r in critical_cols:
                    continue
                if size[i, j] > corr_threshold:
                    gone.add(c)
                    dropped.append({"feature": c, "value": float(size[i, j]),
                                    "reason": f"correlated with {r}"})
    out = {d["feature"] for d in dropped}
    return FittedSelection([c for c in df.columns if c not in out], dropped)


# --- features -------------------------------------------------------------------------------

FEATURE_REPORT = {"feature": "string", "type": "string"}


def features_auto(df: DataFrame, degree: int = 2, datetime_cols: Sequence[str] = (),
                  binning: Mapping[str, int | Sequence[float]] | None = None,
                  columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Polynomial terms of the numeric columns, date parts, and equal-width bins."""
    out = polynomial_features(df, columns, degree)
    lines = [(c, "polynomial") for c in out.columns[len(df.columns):]]
    if datetime_cols:
        at = len(out.columns)
        out = date_parts(out, datetime_cols)
        lines += [(c, "date part") for c in out.columns[at:]]
    if binning:
        at = len(out.columns)
        out = EqualWidthBinner(binning).fit(df).transform(out)
        lines += [(c, "bin") for c in out.columns[at:]]
    return out, report(df, FEATURE_REPORT, lines)
