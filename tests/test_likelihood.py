"""Exponents of the power families against fine grids over the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.functions import likelihood
from tabprep.functions.likelihood import fit_lambdas
from tabprep.operators.distribution import DistributionTransformer
from tabprep.sources.storage import stored


def exact(x, lam, kind):
    """Log-likelihood per row with powers in extended range."""
    t = np.log(x) if kind == "box_cox" else np.sign(x) * np.log1p(np.abs(x))
    return likelihood.log_likelihood(t, np.ones(len(t)), lam, kind)


def plain(x, lam, kind):
    if kind == "box_cox":
        return (x ** lam - 1) / lam
    up = ((np.abs(x) + 1) ** lam - 1) / lam
    return np.where(x >= 0, up, -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam))


CASES = [("box_cox", lambda r: r.lognormal(2, 1, 3000)), ("box_cox", lambda r: r.normal(1000, 60, 3000) ** (1 / 40)),
         ("box_cox", lambda r: r.normal(1000, 60, 3000) ** (-1 / 35)), ("box_cox", lambda r: r.normal(500, 30, 2000) ** (1 / 700)),
         ("yeo_johnson", lambda r: r.gamma(2, 3, 3000) - 4), ("yeo_johnson", lambda r: -r.lognormal(1, 1.5, 3000)),
         ("yeo_johnson", lambda r: np.append(r.normal(0, 1, 2000), [1e12])), ("box_cox", lambda r: np.where(r.random(999) < 0.3, 2.0, 5.0))]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_exponents_equal_a_fine_grid(spark, case):
    kind, draw = CASES[case]
    x = draw(np.random.default_rng(case))
    got = fit_lambdas(spark.createDataFrame(pd.DataFrame({"x": x})).repartition(3), {"x": (kind, F.col("x"))})["x"]
    centre, step = got, 0.02 * max(1, abs(got))
    for _ in range(4):  # a wrong exponent would be left behind
        grid = centre + np.linspace(-10, 10, 81) * step
        centre, step = max(grid, key=lambda g: exact(x, g, kind)), step / 10
    assert got == pytest.approx(centre, abs=2e-4 * max(1, abs(centre)))


def test_likelihood_equals_the_plain_formula():
    x = np.random.default_rng(1).gamma(2, 2, 500)
    for kind, values in (("box_cox", x), ("yeo_johnson", x - 3)):
        t = np.log(values) if kind == "box_cox" else np.sign(values) * np.log1p(np.abs(values))
        for lam in (-1.5, 0.3, 1.0, 2.7):
            want = (lam - 1) * t.mean() - 0.5 * np.log(plain(values, lam, kind).var())
            assert exact(values, lam, kind) == pytest.approx(want, abs=1e-9)
        near, at = exact(values, 1e-12, kind), exact(values, 0.0, kind)
        assert near == pytest.approx(at, abs=1e-9)
    assert np.isfinite(exact(x, 5000.0, "box_cox")) and np.isfinite(exact(x - 3, -5000.0, "yeo_johnson"))


def test_constant_missing_and_empty_columns(spark):
    df = spark.range(9).select(F.lit(3.0).alias("one"), F.lit(None).cast("double").alias("none"),
                               (F.col("id") - 20).cast("double").alias("low"), (F.col("id") + 1.0).alias("x"))
    kinds = {"one": "box_cox", "none": "box_cox", "low": "box_cox", "x": "yeo_johnson"}
    got = fit_lambdas(df, {c: (k, F.col(c)) for c, k in kinds.items()})
    assert got["one"] == 1.0 and set(got) == {"one", "x"}
    assert fit_lambdas(df.where("x < 0"), {"x": ("box_cox", F.col("x"))}) == {}
    assert DistributionTransformer("box_cox", ["one", "none"]).fit_transform(df).select("one").distinct().count() == 1


def test_many_columns_at_once(spark):
    df = stored(spark.range(4000).select(*[(F.exp(F.randn(k) * (k + 1) / 3)).alias(f"c{k}") for k in range(12)]))
    fitted = DistributionTransformer("box_cox", handle_zeros="ignore").fit(df)
    assert all(abs(p["lambda"]) < 0.15 for p in fitted.params.values()) and len(fitted.params) == 12
