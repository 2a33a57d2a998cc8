"""Many per-column measures in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.columns import as_double


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted skewness from Spark's population skewness."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows complete for both; null for a constant column."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


_MEASURES = {
    "n": lambda c: F.count(c),
    "nulls": lambda c: F.count_if(c.isNull()),
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "var": F.var_samp,
    "var_pop": F.var_pop,
    "min": F.min,
    "max": F.max,
    "skew": adjusted_skew,
    "skew_pop": F.skewness,
    "kurt_pop": F.kurtosis,
    "negatives": lambda c: F.count_if(c < 0),
    "non_positives": lambda c: F.count_if(c <= 0),
    "infinite": lambda c: F.count_if(F.abs(c) == float("inf")),
    "distinct": F.count_distinct,
}


def measure(name: str, c: Column) -> Column:
    return _MEASURES[name](c)


def expressions(df: DataFrame, columns: Sequence[str] | Mapping[str, Column]) -> dict[str, Column]:
    if isinstance(columns, Mapping):
        return dict(columns)
    return {c: F.nanvl(as_double(c), F.lit(None).cast("double")) for c in columns}  # NaN is missing


def profile(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
            measures: Sequence[str]) -> dict[str, dict[str, float]]:
    """``{column: {measure: value}}`` for all columns and measures, from one scan."""
    exprs = expressions(df, columns)
    if not exprs:
        return {}
    aggs = [measure(m, e).alias(f"m{i}_{j}")
            for i, e in enumerate(exprs.values()) for j, m in enumerate(measures)]
    row = df.agg(*aggs).first()
    width = len(measures)
    return {c: {m: row[i * width + j] for j, m in enumerate(measures)}
            for i, c in enumerate(exprs)}
