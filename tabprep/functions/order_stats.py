"""Exact order statistics and quantiles of any number of columns, fully distributed.

The built-in exact ``percentile`` keeps every distinct value of a column in one task. Here each pass
counts values in a bounded number of bins per column (partial aggregation on the map side, so a
hot value costs nothing), the driver looks only at the bin counts, and the next pass refines the few
bins that hold a wanted rank. A bin whose minimum equals its maximum is settled, so repeated values
end the search at once. When the wanted bins hold few rows, their distinct values are counted and
the ranks are read off. No value ever has to be approximated.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.columns import small_table
from tabprep.functions.moments import expressions

MAX_BINS = 4_096
TOTAL_BINS = 1 << 18
FINISH_ROWS = 200_000
_HUGE = 1e15

Key = tuple[str, object]


def summary(df: DataFrame, columns: Sequence[str] | Mapping[str, Column]) -> dict[Key, tuple[int, float, float]]:
    """``{(column, None): (non-null count, min, max)}``."""
    exprs = expressions(df, columns)
    row = df.agg(*[f(e) for e in exprs.values() for f in (F.count, F.min, F.max)]).first()
    return {(c, None): tuple(row[3 * i: 3 + 3 * i]) for i, c in enumerate(exprs)}


def _position(v: Column, log_scale: Column) -> Column:
    """A monotone position of the value that neither overflows nor loses order."""
    huge = F.signum(v) * F.log1p(F.least(F.abs(v), F.lit(1.7e308)))
    return F.when(log_scale, huge).otherwise(v / 2)


def _place(v: float, log_scale: bool) -> float:
    if log_scale:
        return math.copysign(math.log1p(min(abs(v), 1.7e308)), v)
    return v / 2


class _Series:
    """One run of values in which some ranks are wanted."""

    def __init__(self, lo: float, hi: float, wanted: dict[int, list[tuple[Key, int]]]):
        self.lo, self.hi, self.wanted = lo, hi, wanted

    def params(self, bins: int) -> tuple[float, float, bool]:
        log_scale = max(abs(self.lo), abs(self.hi)) > _HUGE
        lo, hi = _place(self.lo, log_scale), _place(self.hi, log_scale)
        return lo, bins / (hi - lo) if hi > lo else 0.0, log_scale


def order_statistics(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
                     wanted: Callable[[Key, int], Sequence[int]],
                     known: Mapping[Key, tuple[int, float, float]] | None = None,
                     finish_rows: int | None = None) -> dict[Key, dict[int, float]]:
    """Values at the 0-based ranks ``wanted(key, n)`` of every column, as doubles.

    ``functions.selection`` finds them in any number of groups and without a detour over doubles.
    """
    finish_rows = FINISH_ROWS if finish_rows is None else finish_rows
    exprs = expressions(df, columns)
    known = dict(known) if known is not None else summary(df, exprs)
    found: dict[Key, dict[int, float]] = {k: {} for k in known}
    series: list[_Series] = []
    start: list[Key] = []
    for key, (n, lo, hi) in known.items():
        pending: dict[int, list[tuple[Key, int]]] = {}
        for r in sorted(set(wanted(key, n))) if n else ():
            if r == 0 or lo == hi:
                found[key][r] = float(lo)
            elif r == n - 1:
                found[key][r] = float(hi)
            else:
                pending[r] = [(key, r)]
        if pending:
            series.append(_Series(float(lo), float(hi), pending))
            start.append(key)
    if not series:
        return found

    spark = df.sparkSession
    def read_off(narrowed: DataFrame) -> dict[Key, dict[int, float]]:
        """The wanted ranks from the counts of all distinct values ``v`` of each series ``s``."""
        exact = (narrowed.groupBy("s", "v").agg(F.count("*").alias("n"))
                 .toArrow().to_pandas().sort_values(["s", "v"]))
        for s, part in exact.groupby("s", sort=False):
            ends = np.cumsum(part["n"].to_numpy())
            v = part["v"].to_numpy()
            for local, owners in series[s].wanted.items():
                value = float(v[int(np.searchsorted(ends, local, side="right"))])
                for key, rank in owners:
                    found[key][rank] = value
        return found

    if sum(known[key][0] for key in start) <= finish_rows:
        return read_off(df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("s"), exprs[key[0]].cast("double").alias("v")) for i, key in enumerate(start)])))
            .where(F.col("v").isNotNull()))
    bins = _bins_for(series)
    params = [s.params(bins) for s in series]
    # parameters as literals: no join in the first pass over the source
    binned = df.select(F.inline(F.array(*[
        F.struct(_bin(exprs[key[0]].cast("double"), i, bins, *map(F.lit, params[i])).alias("b"),
                 exprs[key[0]].cast("double").alias("v"))
        for i, key in enumerate(start)]))).where(F.col("v").isNotNull())

    while True:
        counts = (binned.groupBy("b")
                  .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                  .toArrow().to_pandas().sort_values("b"))
        children: list[tuple[int, _Series]] = []
        rows_left = 0
        for s, part in counts.groupby(counts["b"] // bins, sort=False):
            ends = np.cumsum(part["n"].to_numpy())
            b, n, lo, hi = (part[c].to_numpy() for c in ("b", "n", "lo", "hi"))
            inside: dict[int, dict[int, list[tuple[Key, int]]]] = defaultdict(dict)
            for r, owners in series[s].wanted.items():
                i = int(np.searchsorted(ends, r, side="right"))
                local = r - (int(ends[i]) - int(n[i]))
                if local == 0 or lo[i] == hi[i]:
                    value = float(lo[i])
                elif local == n[i] - 1:
                    value = float(hi[i])
                else:
                    inside[i].setdefault(local, []).extend(owners)
                    continue
                for key, rank in owners:
                    found[key][rank] = value
            for i, pending in inside.items():
                children.append((int(b[i]), _Series(float(lo[i]), float(hi[i]), pending)))
                rows_left += int(n[i])
        if not children:
            return found
        series = [c[1] for c in children]
        bins = _bins_for(series)
        params = [s.params(bins) for s in series]
        picked = small_table(spark, {"b": pa.array([c[0] for c in children], pa.int32()),
                                     **_columns(params)})
        narrowed = binned.join(F.broadcast(picked), "b")
        if rows_left <= finish_rows or not all(math.isfinite(p[1]) for p in params):
            return read_off(narrowed)
        binned = _binned(narrowed.drop("b"), bins)


def _bins_for(series: Sequence[_Series]) -> int:
    return max(64, min(MAX_BINS, TOTAL_BINS // len(series)))


def _columns(params: Sequence[tuple[float, float, bool]]) -> dict[str, pa.Array]:
    return {"s": pa.array(range(len(params)), pa.int32()),
            "lo": pa.array([p[0] for p in params], pa.float64()),
            "scale": pa.array([p[1] for p in params], pa.float64()),
            "lg": pa.array([p[2] for p in params], pa.bool_())}


def _bin(v: Column, s, bins: int, lo: Column, scale: Column, lg: Column) -> Column:
    """Bin number over all series: ``s * bins`` plus the bin within the series."""
    inside = F.least(F.greatest((_position(v, lg) - lo) * scale, F.lit(0.0)), F.lit(bins - 1.0))
    return inside.cast("int") + s * bins


def _binned(df: DataFrame, bins: int) -> DataFrame:
    number = _bin(F.col("v"), F.col("s"), bins, F.col("lo"), F.col("scale"), F.col("lg"))
    return df.select(number.alias("b"), "v")


def _interpolate(n: int, p: float, at: Mapping[int, float]) -> float:
    spot = (n - 1) * p
    low = math.floor(spot)
    high = min(low + 1, n - 1)
    return at[low] + (at[high] - at[low]) * (spot - low)


def _ranks(n: int, probs: Sequence[float]) -> list[int]:
    out = set()
    for p in probs:
        low = math.floor((n - 1) * p)
        out |= {low, min(low + 1, n - 1)}
    return sorted(out)


def quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
              probs: Sequence[float],
              known: Mapping[str, Mapping[str, float]] | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column; None for a column without values.

    ``known`` may carry a profile with ``n``, ``min`` and ``max`` to save the first scan.
    """
    exprs = expressions(df, columns)
    if not exprs:
        return {}
    if known is not None:
        seen = {(c, None): (known[c]["n"], known[c]["min"], known[c]["max"]) for c in exprs}
    else:
        seen = summary(df, exprs)
    at = order_statistics(df, exprs, lambda key, n: _ranks(n, probs), known=seen)
    return {c: [_interpolate(seen[c, None][0], p, at[c, None]) if seen[c, None][0] else None
                for p in probs] for c in exprs}

