"""Maximum-likelihood exponents of the Box-Cox and Yeo-Johnson families in four scans, for any number of columns.

Both families are functions of t = log x (Box-Cox) or t = sign(x) log(1 + |x|) (Yeo-Johnson). A histogram of t with the
mean in each bin merges over partitions and gives the likelihood of every exponent, so the driver brackets the best one by
doubling and closes in on it without reading the data again. What the bins blur is mended by two steps on the data: the
exact first derivative at the exponent found, divided by the second derivative of the histogram.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1_024
#: powers are taken relative to the largest one from this exponent of e on
_LARGE = 300.0


def _moved(t: np.ndarray, lam: float, kind: str) -> tuple[np.ndarray, float]:
    """Transformed values divided by e**m, and m."""
    power = np.full(len(t), lam) if kind == "box_cox" else np.where(t >= 0, lam, 2 - lam)
    size = t if kind == "box_cox" else np.abs(t)
    u = power * size
    m = max(0.0, float(u.max()) - _LARGE)
    small = np.abs(u) < 1e-8
    safe = np.where(small, 1.0, u)
    grown = np.where(small, 1 + u / 2, (np.exp(np.where(small, 0, u) - m) - math.exp(-m)) / safe if m
                     else np.expm1(np.where(small, 0, u)) / safe)
    return (size if kind == "box_cox" else t) * grown, m


def log_likelihood(t: np.ndarray, weight: np.ndarray, lam: float, kind: str) -> float:
    """Per row, up to a constant, of weighted values of t; minus infinity if all transformed values are equal."""
    g, m = _moved(t, lam, kind)
    n = weight.sum()
    mean = (weight * g).sum() / n
    var = (weight * (g - mean) ** 2).sum() / n
    if not np.isfinite(var) or var <= 0:
        return -math.inf
    return (lam - 1) * float((weight * t).sum() / n) - 0.5 * math.log(var) - m


def best_exponent(t: np.ndarray, weight: np.ndarray, kind: str) -> float:
    """Best exponent of a histogram: the range doubles until its best point lies inside, then shrinks around it."""
    centre, reach = (0.0 if kind == "box_cox" else 1.0), 2.0
    while True:
        grid = centre + np.linspace(-reach, reach, 33)
        scores = [log_likelihood(t, weight, g, kind) for g in grid]
        top = int(np.argmax(scores))
        if 0 < top < 32:
            break
        reach *= 2
        if reach > 1e9:
            raise ValueError("the likelihood has no maximum")
    step = grid[1] - grid[0]
    while step > 1e-7:
        grid = grid[top] + np.linspace(-step, step, 17)
        top = int(np.argmax([log_likelihood(t, weight, g, kind) for g in grid]))
        step = grid[1] - grid[0]
    return float(grid[top])


def _bend(t: np.ndarray, weight: np.ndarray, lam: float, kind: str) -> float:
    h = 1e-3 * max(1.0, abs(lam))
    left, top, right = (log_likelihood(t, weight, lam + d, kind) for d in (-h, 0, h))
    return (left - 2 * top + right) / h ** 2


def _derivative_parts(t: Column, lam: float, kind: str, low: float, high: float) -> tuple[Column, Column]:
    """Transformed value and its derivative by the exponent, both divided by one power of e."""
    size = t if kind == "box_cox" else F.abs(t)
    power = F.lit(lam) if kind == "box_cox" else F.when(t >= 0, F.lit(lam)).otherwise(F.lit(2 - lam))
    ends = [lam * low, lam * high] if kind == "box_cox" else [lam * max(high, 0.0), (2 - lam) * max(-low, 0.0)]
    m = max(0.0, max(ends) - _LARGE)
    u = power * size
    e, one = F.exp(u - F.lit(m)), F.lit(math.exp(-m))
    small = F.abs(u) < 1e-3
    first = F.when(small, one * (1 + u / 2 + u * u / 6 + u * u * u / 24)).otherwise((F.expm1(u) if not m else e - one) / u)
    second = F.when(small, one * (F.lit(0.5) + u / 3 + u * u / 8 + u * u * u / 30)).otherwise((e * (u - 1) + one) / (u * u))
    return (size if kind == "box_cox" else t) * first, size * size * second


def fit_lambdas(df: DataFrame, wanted: Mapping[str, tuple[str, Column]]) -> dict[str, float]:
    """Maximum-likelihood exponent per column for ``(family, expression)``.

    Rows that are NULL (for Box-Cox also those not above 0) are left out. A column without two different values has no
    best exponent and gets 1, which keeps its shape; one without values gets none.
    """
    if not wanted:
        return {}
    logs = {c: F.when(x > 0, F.log(x)) if kind == "box_cox" else F.signum(x) * F.log1p(F.abs(x))
            for c, (kind, x) in wanted.items()}
    row = df.agg(*[f(t) for t in logs.values() for f in (F.count, F.min, F.max, F.avg)]).first()
    seen = {c: row[4 * i:4 * i + 4] for i, c in enumerate(logs)}
    out = {c: 1.0 for c, (n, low, high, _) in seen.items() if n and low == high}
    todo = [c for c, (n, low, high, _) in seen.items() if n and low < high]
    if not todo:
        return out
    # Box-Cox values are divided by their geometric mean, which keeps the powers small
    centre = {c: seen[c][3] if wanted[c][0] == "box_cox" else 0.0 for c in todo}
    t = {c: logs[c] - F.lit(centre[c]) for c in todo}
    spots = []
    for i, c in enumerate(todo):
        _, low, high, _ = seen[c]
        spot = F.least(F.floor((logs[c] - F.lit(low)) * F.lit(BINS / (high - low))), F.lit(BINS - 1)).cast("int")
        spots.append(F.struct(F.lit(i).alias("c"), spot.alias("b"), t[c].alias("t")))
    bins = (df.select(F.inline(F.array(*spots))).where(F.col("t").isNotNull()).groupBy("c", "b")
            .agg(F.count("*").alias("n"), F.avg("t").alias("t")).toArrow().to_pandas())  # BINS rows a column
    held = {c: (part["t"].to_numpy(), part["n"].to_numpy(float)) for i, c in enumerate(todo)
            for part in [bins[bins["c"] == i]]}
    kinds = {c: wanted[c][0] for c in todo}
    found = {c: best_exponent(*held[c], kinds[c]) for c in todo}
    for _ in range(2):
        parts = {c: _derivative_parts(t[c], found[c], kinds[c], seen[c][1] - centre[c], seen[c][2] - centre[c]) for c in todo}
        row = df.agg(*[a for g, d in parts.values() for a in (F.covar_pop(g, d), F.var_pop(g))]).first()
        for i, c in enumerate(todo):
            shared, var = row[2 * i], row[2 * i + 1]
            bend = _bend(*held[c], found[c], kinds[c])
            if var and math.isfinite(var) and math.isfinite(shared) and bend < 0:
                slope = (seen[c][3] - centre[c]) - shared / var
                found[c] -= slope / bend
    return {**out, **found}
