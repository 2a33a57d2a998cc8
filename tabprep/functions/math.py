"""Scalar formulas, as Columns and for fitted numbers on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprep.functions.columns import nan_to_null

# Coefficients of the published rational approximation of the inverse normal
# distribution function (relative error below 1.2e-9).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00, 1.0)
_TAIL = 0.02425


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip to bounds; NULL stays NULL."""
    return F.when(c < lo, F.lit(float(lo))).when(c > hi, F.lit(float(hi))).otherwise(c)


def outside(c: Column, lo: float, hi: float) -> Column:
    return (c < F.lit(float(lo))) | (c > F.lit(float(hi)))


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for a in coefficients[1:]:
        out = out * x + F.lit(a)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for 0 < p < 1."""
    near = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(_C, near) / _horner(_D, near)
    centre = p - 0.5
    body = centre * _horner(_A, centre * centre) / _horner(_B, centre * centre)
    return F.when(p < _TAIL, tail).when(p > 1 - _TAIL, -tail).otherwise(body)


def box_cox(x: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        return F.when(x > 0, F.log(x))
    return F.when(x > 0, (F.pow(x, F.lit(lam)) - 1) / lam)


def box_cox_inverse(y: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        return F.exp(y)
    return nan_to_null(F.pow(y * lam + 1, F.lit(1 / lam)))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    other = 2 - lam
    down = -F.log1p(-x) if abs(other) < 1e-12 else -(F.pow(1 - x, F.lit(other)) - 1) / other
    return F.when(x >= 0, up).when(x < 0, down)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.expm1(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    other = 2 - lam
    down = -F.expm1(-y) if abs(other) < 1e-12 else 1 - F.pow(1 - y * other, F.lit(1 / other))
    return nan_to_null(F.when(y >= 0, up).when(y < 0, down))


def normality_p(n: int, skew_pop: float | None, kurt_pop: float | None) -> float | None:
    """p value of the K-squared test from sample moments (population skewness, excess kurtosis);
    None below 8 values, where the test is not defined."""
    if n < 8 or skew_pop is None or kurt_pop is None:
        return None
    if math.isnan(skew_pop) or math.isnan(kurt_pop):
        return None
    y = skew_pop * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
            / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(w2) / 2)
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt_pop + 3 - mean) / math.sqrt(var)
    s = (6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
         * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s ** 2))
    ratio = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def chi_square_quantile(p: float, dof: int) -> float:
    """Value whose chi-square distribution function is ``p``, by bisection on the series."""
    def cdf(x: float) -> float:
        s, h = dof / 2, x / 2
        if h <= 0:
            return 0.0
        term = total = 1 / s
        for i in range(1, 10_000):
            term *= h / (s + i)
            total += term
            if term < total * 1e-16:
                break
        return min(1.0, total * math.exp(-h + s * math.log(h) - math.lgamma(s)))

    lo, hi = 0.0, max(10.0, 4.0 * dof)
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


#: steps by which an argument is raised before the series of the digamma function, which then is exact to 1e-11
_RAISE = 8


def _digamma_series(x, log):
    return log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)


def digamma_value(x: float) -> float:
    return _digamma_series(x + _RAISE, math.log) - sum(1 / (x + i) for i in range(_RAISE))


def digamma(c: Column) -> Column:
    """Derivative of the logarithm of the gamma function, for positive numbers."""
    x = c.cast("double")
    out = _digamma_series(x + F.lit(float(_RAISE)), F.log)
    for i in range(_RAISE):
        out = out - 1 / (x + F.lit(float(i)))
    return out
