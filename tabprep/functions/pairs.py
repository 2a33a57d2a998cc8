"""Sums over all pairs of columns (Gram, covariance, correlation matrices) in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.moments import correlation, expressions

#: up to this many columns the pairs are plain aggregates; above it, array blocks per partition
NARROW = 24


def _symmetric(d: int, upper: Iterator) -> np.ndarray:
    out = np.full((d, d), np.nan)
    for i in range(d):
        for j in range(i, d):
            v = next(upper)
            out[i, j] = out[j, i] = np.nan if v is None else v
    return out


def _block_sums(df: DataFrame, exprs: Mapping[str, Column], centre: np.ndarray) -> dict[str, np.ndarray]:
    """Pairwise-complete n, sum x, sum x^2, sum xy, each as a d x d matrix."""
    d = len(exprs)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            part = np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices((d, d))
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total[0].ravel(),
                                "sx": total[1].ravel(), "sxx": total[2].ravel(),
                                "sxy": total[3].ravel()})

    rows = (df.select(*[e.cast("double").alias(f"x{i}") for i, e in enumerate(exprs.values())])
            .mapInPandas(partial, "i int, j int, n double, sx double, sxx double, sxy double")
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])
            .toArrow().to_pandas())
    out = {}
    for c in ("n", "sx", "sxx", "sxy"):
        m = np.zeros((d, d))
        m[rows["i"], rows["j"]] = rows[c]
        out[c] = m
    return out


def gram(df: DataFrame, columns: Sequence[str] | Mapping[str, Column]) -> tuple[int, np.ndarray]:
    """Row count and the matrix of raw cross products (columns without nulls)."""
    exprs = expressions(df, columns)
    xs = list(exprs.values())
    d = len(xs)
    if d > NARROW:
        sums = _block_sums(df, exprs, np.zeros(d))
        return int(sums["n"].max()), sums["sxy"]
    row = df.agg(F.count("*"), *[F.sum(xs[i] * xs[j]) for i in range(d) for j in range(i, d)]).first()
    return row[0], _symmetric(d, iter(row[1:]))


def gram_and_ends(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, list[tuple[float, float]]]:
    """``gram``, and the smallest and largest value of each column, from one scan of narrow tables."""
    xs = list(expressions(df, columns).values())
    if len(xs) > NARROW:
        row = df.agg(*[f(x) for x in xs for f in (F.min, F.max)]).first()
        return *gram(df, columns), list(zip(row[::2], row[1::2], strict=True))
    d, pairs = len(xs), [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    row = df.agg(F.count("*"), *[F.sum(xs[i] * xs[j]) for i, j in pairs], *[f(x) for x in xs for f in (F.min, F.max)]).first()
    ends = row[1 + len(pairs):]
    return row[0], _symmetric(d, iter(row[1:1 + len(pairs)])), list(zip(ends[::2], ends[1::2], strict=True))


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and the sample covariance matrix (columns without nulls)."""
    exprs = expressions(df, columns)
    xs = list(exprs.values())
    d = len(xs)
    if d > NARROW:
        means = np.array(df.agg(*[F.avg(x) for x in xs]).first(), dtype=float)
        s = _block_sums(df, exprs, means)
        n = s["n"]
        return means, (s["sxy"] - s["sx"] * s["sx"].T / n) / (n - 1)
    row = df.agg(*[F.avg(x) for x in xs],
                 *[F.covar_samp(xs[i], xs[j]) for i in range(d) for j in range(i, d)]).first()
    return np.array(row[:d], dtype=float), _symmetric(d, iter(row[d:]))


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson matrix over the rows complete for each pair; NaN for a constant column."""
    exprs = expressions(df, columns)
    xs = list(exprs.values())
    d = len(xs)
    if d > NARROW:
        means = np.array(df.agg(*[F.avg(x) for x in xs]).first(), dtype=float)
        s = _block_sums(df, exprs, np.nan_to_num(means))
        n = s["n"]
        with np.errstate(all="ignore"):
            cov = s["sxy"] - s["sx"] * s["sx"].T / n
            var = s["sxx"] - s["sx"] ** 2 / n
            out = cov / np.sqrt(var * var.T)
    else:
        row = df.agg(*[correlation(xs[i], xs[j]) for i in range(d) for j in range(i + 1, d)]).first()
        upper = iter(row)
        out = np.eye(d)
        for i in range(d):
            for j in range(i + 1, d):
                v = next(upper)
                out[i, j] = out[j, i] = np.nan if v is None else v
    np.fill_diagonal(out, 1.0)
    return out
