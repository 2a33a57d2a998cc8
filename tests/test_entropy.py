"""Nearest-neighbour mutual information against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.functions import running
from tabprep.functions.entropy import (
    SHRINK, counts_within, mutual_information_with_classes, mutual_information_with_numbers)
from tabprep.functions.math import digamma, digamma_value
from tabprep.operators.features import FeatureSelector, binned_mutual_information, mutual_information


def psi(n):
    """Euler's constant and harmonic numbers."""
    return np.array([-0.57721566490153286 + sum(1 / i for i in range(1, int(v))) for v in np.atleast_1d(n)])


def with_classes(x, y, k=3):
    sizes = y.map(y.value_counts())
    x, y, sizes = (v[sizes > 1].to_numpy() for v in (x, y, sizes))
    m = []
    for i in range(len(x)):
        far = np.sort(np.delete(np.abs(x[y == y[i]] - x[i]), np.flatnonzero(np.flatnonzero(y == y[i]) == i)))
        m.append((np.abs(x - x[i]) <= far[min(k, len(far)) - 1] * (1 - SHRINK)).sum())
    if not len(x):
        return 0.0
    return max(0.0, float(psi(len(x))[0] + psi(np.minimum(k, sizes - 1)).mean() - psi(sizes).mean() - psi(m).mean()))


def with_numbers(x, y, k=3):
    x, y = x / x.std(ddof=0), y / y.std(ddof=0)
    gaps = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    s = np.sort(gaps, axis=1)[:, k] * (1 - SHRINK)
    a, b = ((np.abs(v[:, None] - v) <= s[:, None]).sum(1) for v in (x, y))
    return max(0.0, float(psi(len(x))[0] + psi(k)[0] - psi(a).mean() - psi(b).mean()))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 6, 2000)
    y[:700] = 2  # one class holds a third
    pdf = pd.DataFrame({"near": y + rng.normal(0, 0.7, 2000), "ties": (y + rng.integers(0, 4, 2000)).astype(float),
                        "noise": rng.random(2000), "y": y.astype(str)})
    pdf.loc[5:8, "y"] = ["alone", "pair", "pair", "lone"]
    pdf.loc[::11, "noise"] = np.nan
    return pdf


@pytest.mark.parametrize("rows", [1_000_000, 60, 4])
def test_classes(spark, monkeypatch, data, rows):
    monkeypatch.setattr(running, "ROWS_PER_BUCKET", rows)
    part = data if rows > 4 else data[:120]
    names = ["near", "ties", "noise"]
    got = mutual_information_with_classes(spark.createDataFrame(part).repartition(3), names, "y")
    for c in names:
        known = part[part[c].notna()]
        assert got[c] == pytest.approx(with_classes(known[c], known["y"]), abs=1e-9)
    assert got["near"] > 0.4 * (rows > 4) and got["noise"] < 0.1 + (rows == 4)


@pytest.mark.parametrize("plan", ["auto", "cells"])
def test_numbers(spark, monkeypatch, data, plan):
    monkeypatch.setattr(running, "ROWS_PER_BUCKET", 500)
    pdf = data[["near", "ties", "noise"]].assign(t=lambda p: p["near"] ** 2 + p["ties"])
    got = mutual_information_with_numbers(spark.createDataFrame(pdf), ["near", "ties", "noise"], "t", plan=plan)
    for c in got:
        known = pdf[pdf[c].notna()]
        assert got[c] == pytest.approx(with_numbers(known[c].to_numpy(), known["t"].to_numpy()), abs=1e-9)


def test_selector_chooses_by_target_type(spark, data):
    df = spark.createDataFrame(data.assign(t=data["near"] * 2))
    names = ["near", "noise"]
    assert mutual_information(df, names, "y") == mutual_information_with_classes(df, names, "y")
    fitted = FeatureSelector("univariate", k=1, score_func=mutual_information, columns=names).fit(df, "t")
    assert fitted.selected == ["near"] and fitted.scores["near"] > 2


def test_bins_with_a_value_for_each_row(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.random(3000), "y": np.arange(3000)})
    assert binned_mutual_information(spark.createDataFrame(pdf), ["x"], "y")["x"] == pytest.approx(math.log(10), abs=1e-6)


def test_empty_constant_and_missing(spark):
    df = spark.range(30).select(F.lit(1.0).alias("one"), F.lit(float("nan")).alias("gone"), F.col("id").cast("double").alias("x"),
                                (F.col("id") % 2).alias("y"))
    got = mutual_information_with_classes(df, ["one", "gone"], "y")
    assert got == {"one": pytest.approx(0, abs=1e-9), "gone": 0.0}
    assert mutual_information_with_numbers(df, ["one", "gone"], "x") == {"one": 0.0, "gone": 0.0}
    assert mutual_information_with_classes(df.where("x < 0"), ["one"], "y") == {"one": 0.0}
    assert mutual_information_with_numbers(df.where("x < 3"), ["x"], "x") == {"x": 0.0}


def test_counts_and_digamma(spark, monkeypatch):
    monkeypatch.setattr(running, "ROWS_PER_BUCKET", 7)
    x = np.round(np.random.default_rng(3).normal(0, 2, 90), 1)
    rows = [(k % 2, k, float(v), 0.5 * (k % 4)) for k, v in enumerate(x)]
    got = {r["i"]: r["m"] for r in counts_within(spark.createDataFrame(rows, "f int, i long, x double, s double")).collect()}
    assert got == {i: sum(v - s <= w <= v + s for g, _, w, _ in rows if g == f) for f, i, v, s in rows}
    values = [r[0] for r in spark.range(1, 200).select(digamma(F.col("id"))).collect()]
    assert np.allclose(values, psi(np.arange(1, 200)), rtol=0, atol=1e-11)
    assert digamma_value(5) == pytest.approx(psi(5)[0], abs=1e-12)
