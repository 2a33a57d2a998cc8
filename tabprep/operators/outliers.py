"""Outliers: bounds, flags, removal, clipping, reports, distance and forest detectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabprep.base import Fitted, Step, read_side_table, write_side_table
from tabprep.functions.columns import (
    any_of, as_double, col, flag, free_name, number, numeric_columns, replace_columns)
from tabprep.functions.hashing import hash_number, hash_text
from tabprep.functions.math import chi_square_quantile, clip, outside
from tabprep.functions.moments import profile
from tabprep.functions.order_stats import quantiles
from tabprep.sources.storage import stored

METHODS = ("iqr", "zscore", "mahalanobis")
#: how many numbers ``hash_number`` can give
_HASHES = float(1 << 52)
HANDLING = ("flag", "flag_columns", "remove", "clip", "winsorize")


@dataclass
class FittedBounds(Fitted):
    """Lower and upper bound per column, and what to do with values outside."""

    bounds: dict = field(default_factory=dict)
    handling: str = "flag"

    def _present(self, df: DataFrame) -> list[str]:
        return [c for c in self.bounds if c in df.columns]

    def is_outlier(self, c: str) -> Column:
        return outside(as_double(c), *self.bounds[c])

    def any_outlier(self, df: DataFrame) -> Column:
        """True where any fitted column is outside; NULL values never are."""
        return any_of([F.coalesce(self.is_outlier(c), F.lit(False)) for c in self._present(df)])

    def transform(self, df: DataFrame) -> DataFrame:
        names = self._present(df)
        if self.handling == "flag":
            base = df.drop(*[c for c in df.columns if c.startswith("Outlier_Flag")])
            return base.withColumn("Outlier_Flag", self.any_outlier(df).cast("int"))
        if self.handling == "flag_columns":
            return replace_columns(df, {f"{c}_Outlier_Flag": flag(self.is_outlier(c)) for c in names})
        if self.handling == "remove":
            return df.where(~self.any_outlier(df))
        clipped = {c: clip(as_double(c), *self.bounds[c]) for c in names}
        if self.handling == "clip":
            return replace_columns(df, clipped)
        base = [c for c in df.columns if not (c.startswith("Outlier_Flag_") or (
            c.startswith("Original_") and c.endswith("_Outlier")))]
        taken, added = list(base), []
        for c in names:
            kept = free_name(f"Original_{c}_Outlier", taken)
            mark = free_name(f"Outlier_Flag_{c}", [*taken, kept])
            taken += [kept, mark]
            added += [F.when(self.is_outlier(c), as_double(c)).alias(kept),
                      flag(self.is_outlier(c)).alias(mark)]
        whole = free_name("Outlier_Flag_Any", taken)
        return df.select(*[clipped[c].alias(c) if c in clipped else col(c) for c in base], *added,
                         self.any_outlier(df).cast("int").alias(whole))

    def report(self, df: DataFrame) -> DataFrame:
        """Outliers per column, most first; one scan."""
        names = self._present(df)
        row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
                     *[F.count_if(self.is_outlier(c)).alias(f"o{i}") for i, c in enumerate(names)])
        items = [F.struct(
            F.lit(c).alias("column"), F.col(f"o{i}").alias("outliers"),
            F.round(F.col(f"o{i}") * F.lit(100.0) / F.col(f"n{i}"), 2).alias("pct_of_values"),
            F.round(F.lit(float(self.bounds[c][0])), 4).alias("lower_bound"),
            F.round(F.lit(float(self.bounds[c][1])), 4).alias("upper_bound"),
            F.col(f"n{i}").alias("non_null")) for i, c in enumerate(names)]
        return (row.select(F.inline(F.array(*items))).where(F.col("non_null") > 0)
                .orderBy(F.col("outliers").desc(), "column"))

    def outlier_rows(self, df: DataFrame) -> DataFrame:
        """Rows with an outlier, with the names of the columns concerned."""
        which = F.array_compact(F.array(*[F.when(self.is_outlier(c), F.lit(c))
                                          for c in self._present(df)]))
        mark = free_name("outlier_flag", df.columns)
        names = free_name("outlier_columns", df.columns)
        return (df.where(self.any_outlier(df)).withColumn(mark, F.lit(1))
                .withColumn(names, which))


@dataclass
class FittedMahalanobis(Fitted):
    """Squared distance from the mean under the inverse covariance, with a cut."""

    columns: list
    mean: list
    inverse: list
    cut: float
    handling: str = "flag"

    def distance(self) -> Column:
        away = [as_double(c) - F.lit(m) for c, m in zip(self.columns, self.mean, strict=True)]
        total = F.lit(0.0)
        for i, a in enumerate(away):
            for j in range(i, len(away)):
                factor = self.inverse[i][j] * (1 if i == j else 2)
                total = total + F.lit(float(factor)) * a * away[j]
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        far = F.coalesce(self.distance() > F.lit(self.cut), F.lit(False))
        if self.handling == "remove":
            return df.where(~far)
        return df.drop("Outlier_Flag").withColumn("Outlier_Flag", far.cast("int"))


@dataclass
class OutlierDetector(Step):
    """Bounds by quartiles or by z score (robust: median and median absolute deviation)."""

    method: str = "iqr"
    factor: float | Mapping[str, float] = 1.5
    handling: str = "flag"
    columns: Sequence[str] | None = None
    min_non_null: int = 10
    robust: bool = True
    ignore_constant: bool = True
    mad_scale: float = 1.0
    probability: float = 0.999

    def __post_init__(self):
        self.method, self.handling = self.method.lower(), self.handling.lower()
        if self.method not in METHODS:
            raise ValueError(f"no detection by {self.method!r}; there are {METHODS}")
        if self.handling not in HANDLING:
            raise ValueError(f"no handling called {self.handling!r}; there are {HANDLING}")
        factors = self.factor.values() if isinstance(self.factor, Mapping) else [self.factor]
        if any(f <= 0 for f in factors):
            raise ValueError("bounds need a factor above 0")

    def _factor(self, c: str) -> float:
        return self.factor.get(c, 1.5) if isinstance(self.factor, Mapping) else self.factor

    def fit(self, df: DataFrame, target: str | None = None) -> Fitted:
        numbers = numeric_columns(df, [target] if target else [])
        names = numbers if self.columns is None else [c for c in self.columns if c in numbers]
        if self.method == "mahalanobis":
            return self._fit_mahalanobis(df, names)
        wanted = ["n", "min", "max"] + (["mean", "std"] if self.method == "zscore" else [])
        seen = profile(df, names, wanted)
        names = [c for c in names if seen[c]["n"] >= max(1, self.min_non_null)
                 and not ((self.ignore_constant or self.method == "zscore") and seen[c]["min"] == seen[c]["max"])]
        bounds = self._iqr(df, names, seen) if self.method == "iqr" else self._zscore(df, names, seen)
        return FittedBounds(bounds, self.handling)

    def _iqr(self, df, names, seen) -> dict:
        bounds = {}
        for c, (q1, q3) in quantiles(df, names, [0.25, 0.75], seen).items():
            reach = self._factor(c) * (q3 - q1)
            bounds[c] = [q1 - reach, q3 + reach]
        return bounds

    def _zscore(self, df, names, seen) -> dict:
        centre = {c: (seen[c]["mean"], seen[c]["std"] or 0.0) for c in names}
        if self.robust and names:
            middle = {c: q[0] for c, q in quantiles(df, names, [0.5], seen).items()}
            away = {c: F.abs(as_double(c) - F.lit(middle[c])) for c in names}
            for c, (mad,) in quantiles(df, away, [0.5]).items():
                if mad:
                    centre[c] = (middle[c], mad * self.mad_scale)
        return {c: [m - self._factor(c) * s, m + self._factor(c) * s] for c, (m, s) in centre.items()}

    def _fit_mahalanobis(self, df: DataFrame, names: list[str]) -> FittedMahalanobis:
        known = df.where(~any_of([col(c).isNull() for c in names]))
        d = len(names)
        xs = [as_double(c) for c in names]
        row = known.agg(*[F.avg(x) for x in xs], *[
            F.covar_samp(xs[i], xs[j]) for i in range(d) for j in range(i, d)]).first()
        cov = np.zeros((d, d))
        upper = iter(row[d:])
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = next(upper)
        return FittedMahalanobis(names, [float(m) for m in row[:d]], np.linalg.pinv(cov).tolist(),
                                 chi_square_quantile(self.probability, d), self.handling)


def simple_bounds(method: str = "iqr", factor: float = 1.5,
                  columns: Sequence[str] | None = None) -> OutlierDetector:
    """Preset of the six-step preparation: a flag per column, no robust centre, no skipping."""
    return OutlierDetector(method, factor, "flag_columns", columns, min_non_null=1, robust=False,
                           ignore_constant=False)


@dataclass
class FittedForest(Fitted):
    """Intervals of one column that a forest of random splits isolates quickly."""

    column: str
    borders: list
    first_is_outlier: bool
    trees: str | None = None

    def flagged(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with 0/1 column ``name``. Flags alternate between the sorted borders."""
        if not self.borders:
            return df.withColumn(name, F.lit(int(self.first_is_outlier)))
        value = df.withColumn("__v", F.coalesce(as_double(self.column), F.lit(math.nan)))
        cut = Bucketizer(splits=[-math.inf, *self.borders, math.inf], inputCol="__v",
                         outputCol="__b", handleInvalid="keep")
        odd = F.pmod(F.col("__b").cast("int"), F.lit(2)) == 1
        inside = ~odd if self.first_is_outlier else odd
        marked = flag(inside & ~F.isnan(F.col("__v")))
        return cut.transform(value).withColumn(name, marked).drop("__v", "__b")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.flagged(df, f"{self.column}_Outlier_Flag")


def _path_correction(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def tree_samples(known: DataFrame, rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """``tree, v``: for each tree its own ``sample`` of the ``rows`` values (v, key), or all if there are fewer.

    One scan. A row enters each tree with the same small chance, independently: hashes of its key give the gaps between the
    trees it enters, which are geometrically distributed, so most rows are done after one hash. The chance is a little
    higher than needed, and of the rows of a tree those with the smallest hashes for this tree stay. Should a tree get too
    few, which is next to impossible, the chance is doubled.
    """
    wanted = min(sample, rows)
    chance = (sample + 8 * math.sqrt(sample) + 32) / max(rows, 1)
    while True:
        if chance >= 1:
            entries = known.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        else:
            def gap(j: Column | int) -> Column:
                spot = F.concat_ws("#", F.col("key").cast("string"), (F.lit(j) if isinstance(j, int) else j).cast("string"))
                return F.floor(F.log((hash_number(spot, f"{seed}t") + 0.5) / _HASHES) / F.lit(math.log(1 - chance)))

            none = F.array().cast("array<int>")
            # the trees a row enters: each time the number of trees passed over, and the one after them
            walk = F.aggregate(
                F.sequence(F.lit(1), F.lit(trees)),
                F.struct(none.alias("found"), F.lit(-1).cast("bigint").alias("at")),
                lambda acc, j: F.when(acc["at"] >= trees, acc).otherwise(F.struct(
                    F.when(acc["at"] + 1 + gap(j) < trees, F.concat(acc["found"], F.array((acc["at"] + 1 + gap(j)).cast("int"))))
                    .otherwise(acc["found"]).alias("found"),
                    (acc["at"] + 1 + gap(j)).cast("bigint").alias("at"))),
                lambda acc: acc["found"])
            entries = known.where(gap(1) < trees).withColumn("tree", F.explode(walk))
        spot = F.concat_ws("#", F.col("key").cast("string"), F.col("tree").cast("string"))
        place = F.row_number().over(Window.partitionBy("tree").orderBy(hash_text(spot, f"{seed}s"), "key"))
        drawn = stored(entries.withColumn("r", place).where(F.col("r") <= wanted).select("tree", "v"), "tree-samples")
        full = drawn.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") == wanted).count()
        if full == trees or chance >= 1:
            return drawn
        chance *= 2


@dataclass
class IsolationForest(Step):
    """Isolation forest on one column.

    Each tree sees ``sample`` rows of its own, drawn independently from the whole table. On one column a tree is a step
    function of the value and so is the forest, which scores any number of rows with one binary search each. The fitted
    step keeps the trees as a side table: ``tree``, ``start`` of a stretch of values, and their ``length`` of path.
    """

    column: str
    key: str
    trees: int = 100
    sample: int = 256
    contamination: float = 0.05
    seed: int = 42

    def fit(self, df: DataFrame, target: str | None = None) -> FittedForest:
        known = df.select(number(self.column).alias("v"), col(self.key).alias("key")).where(F.col("v").isNotNull())
        rows = known.count()
        if not rows:
            return FittedForest(self.column, [], False)
        size, seed = min(self.sample, rows), self.seed
        depth = math.ceil(math.log2(max(size, 2)))

        def grow(drawn: pd.DataFrame) -> pd.DataFrame:
            tree = int(drawn["tree"].iloc[0])
            values = np.sort(drawn["v"].to_numpy())
            out: list[tuple[int, float, float]] = []
            todo = [(0, len(values), 0, -math.inf, 1)]
            while todo:
                a, b, level, start, node = todo.pop()
                lo, hi = values[a], values[b - 1]
                if level >= depth or b - a <= 1 or lo == hi:
                    out.append((tree, start, level + _path_correction(b - a)))
                    continue
                digits = hashlib.md5(f"{tree}#{node}{seed}c".encode()).hexdigest()[:13]
                cut = lo + (int(digits, 16) + 0.5) / _HASHES * (hi - lo)
                m = a + int(np.searchsorted(values[a:b], cut, side="right"))
                m = min(max(m, a + 1), b - 1)
                todo.append((m, b, level + 1, math.nextafter(cut, math.inf), 2 * node + 1))
                todo.append((a, m, level + 1, start, 2 * node))
            return pd.DataFrame(out, columns=["tree", "start", "length"])

        grown = (tree_samples(known, rows, self.trees, self.sample, seed).groupBy("tree")
                 .applyInPandas(grow, "tree int, start double, length double"))
        mark = write_side_table(grown, "trees")
        ahead = F.lag("length", 1, 0.0).over(Window.partitionBy("tree").orderBy("start"))
        steps = (read_side_table(df.sparkSession, mark).withColumn("delta", F.col("length") - ahead).groupBy("start")
                 .agg(F.sum("delta").alias("delta")).toArrow().to_pandas().sort_values("start"))  # trees x sample rows
        length = steps["delta"].to_numpy().cumsum() / self.trees
        starts = steps["start"].to_numpy()
        # rounded, so that equal paths that were added up in another order stay equal
        score = np.round(np.exp2(-length / max(_path_correction(size), 1e-12)), 9)
        if len(starts) < 2:
            return FittedForest(self.column, [], False, mark)
        placed = Bucketizer(splits=[*starts, math.inf], inputCol="v", outputCol="b").transform(known)
        counts = placed.groupBy("b").agg(F.count("*").alias("n")).toArrow().to_pandas()
        weight = np.zeros(len(starts))
        weight[counts["b"].astype(int)] = counts["n"]
        far = score > _weighted_quantile(score, weight, 1 - self.contamination)
        change = np.flatnonzero(far[1:] != far[:-1]) + 1
        return FittedForest(self.column, [float(v) for v in starts[change]], bool(far[0]), mark)


def _weighted_quantile(values: np.ndarray, counts: np.ndarray, p: float) -> float:
    order = np.argsort(values, kind="stable")
    ends = counts[order].cumsum()
    spot = (ends[-1] - 1) * p
    low, high = (values[order][np.searchsorted(ends, r, side="right")]
                 for r in (math.floor(spot), min(math.floor(spot) + 1, ends[-1] - 1)))
    return low + (high - low) * (spot - math.floor(spot))
