"""Exact distributed statistics against brute force, with limits lowered so that every path runs."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.functions import cells
from tabprep.functions import neighbours as N
from tabprep.functions import order_stats as O
from tabprep.functions import pairs
from tabprep.functions import running as R
from tabprep.functions.hashing import mark_lowest
from tabprep.functions.likelihood import fit_lambdas
from tabprep.functions.math import chi_square_quantile, normal_quantile, normality_p


def skewed_values(n=4000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.lognormal(0, 3, n)
    x[: n // 3] = 7.0
    return np.concatenate([x, [1e300, -1e300, 0.0, -0.5]])


@pytest.mark.parametrize("finish_rows", [0, 50, 200_000])
def test_order_statistics_are_exact(spark, monkeypatch, finish_rows):
    monkeypatch.setattr(O, "FINISH_ROWS", finish_rows)
    x = skewed_values()
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.round(x % 5, 1)}))
    probs = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]
    got = O.quantiles(df, ["x", "y"], probs)
    for c in ("x", "y"):
        assert np.allclose(got[c], pd.Series(df.toPandas()[c]).quantile(probs), rtol=1e-12, atol=0)


def test_order_statistics_every_rank_and_nulls(spark):
    values = [None, 5.0, 5.0, -3.0, float("inf"), float("-inf"), 1e-320, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = O.order_statistics(df, ["x"], lambda key, n: range(n), finish_rows=0)["x", None]
    assert [got[i] for i in range(7)] == sorted(v for v in values if v is not None)


def test_statistics_of_the_small_fixture(spark):
    from tabprep.functions.moments import profile
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 40, 50, 100, 10000, 2, 3, 15, 7)], "x double")
    m = profile(df, ["x"], ["skew", "std", "std_pop"])["x"]
    assert O.quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"] == [7.75, 17.5, 47.5]
    assert m["skew"] == pytest.approx(3.1617421447)
    assert (m["std"], m["std_pop"]) == (pytest.approx(3153.7418005354), pytest.approx(2991.9021725317))


def test_buckets_are_bounded_and_ordered(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"t": rng.integers(0, 40, 3000), "k": np.arange(3000)})
    pdf.loc[:1500, "t"] = 17
    out, _ = R.bucketed(spark.createDataFrame(pdf), ["t", "k"], rows_per_bucket=100)
    got = out.toPandas().sort_values(["t", "k"])
    assert got["__bucket"].is_monotonic_increasing
    assert got["__bucket"].value_counts().max() <= 300
    words = out.select(F.concat(F.lit("w"), F.lpad(F.col("t").cast("string"), 3, "0")).alias("w"), "k")
    got = R.bucketed(words, ["w", "k"], rows_per_bucket=100)[0].toPandas().sort_values(["w", "k"])
    assert got["__bucket"].is_monotonic_increasing and got["__bucket"].nunique() > 10
    assert got["__bucket"].nunique() > 10


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_over_buckets(spark, monkeypatch, descending):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 50)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": rng.permutation(1000) / 7, "a": rng.integers(0, 9, 1000)})
    got = R.running_totals(spark.createDataFrame(pdf), "s", {"a": "total"}, descending).toPandas()
    got = got.sort_values("s", ascending=not descending)
    assert (got["total"].to_numpy() == got["a"].cumsum().to_numpy()).all()


def brute_force(q, d, features, k):
    out = {}
    for _, a in q.iterrows():
        rows = []
        for _, b in d.iterrows():
            both = [f for f in features if not (np.isnan(a[f]) or np.isnan(b[f]))]
            if both:
                total = sum((a[f] - b[f]) ** 2 for f in both)
                rows.append((total * len(features) / len(both), int(b["id"])))
        out[int(a["id"])] = [i for _, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("shared", [20_000, 0])
def test_nearest_equals_brute_force(spark, monkeypatch, shared):
    monkeypatch.setattr(N, "SHARED_DONORS", shared)
    monkeypatch.setattr(N, "MORE_DONORS", shared)
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 20)
    monkeypatch.setattr(cells, "ROWS_PER_CHUNK", 5)
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"id": np.arange(160), "f0": rng.integers(0, 12, 160).astype(float),
                      "f1": rng.integers(0, 30, 160).astype(float)})
    d.loc[:60, ["f0", "f1"]] = [3.0, 4.0]
    d.loc[150:, "f1"] = np.nan
    q = pd.DataFrame({"id": np.arange(500, 540), "f0": rng.integers(-3, 15, 40).astype(float),
                      "f1": rng.integers(0, 30, 40).astype(float)})
    q.loc[:12, ["f0", "f1"]] = [3.0, 5.0]
    q.loc[35:, "f0"] = np.nan
    schema = "id long, f0 double, f1 double"
    none = lambda p: [[int(r.id), *(None if np.isnan(v) else float(v) for v in (r.f0, r.f1))]
                      for r in p.itertuples()]
    donors = spark.createDataFrame(none(d), schema).withColumn("payload", F.col("id") * 10)
    got = N.nearest(spark.createDataFrame(none(q), schema), donors, ["f0", "f1"], 3).toPandas()
    got = got.sort_values(["id", "dist2", "donor"])
    assert (got["payload"] == got["donor"] * 10).all()
    assert got.groupby("id")["donor"].apply(list).to_dict() == brute_force(q, d, ["f0", "f1"], 3)


def test_wide_pair_sums_equal_narrow(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(1000, 1, (300, 3))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(c=lambda p: p["a"] + p["c"] / 100)
    df = spark.createDataFrame(pdf).repartition(3)
    monkeypatch.setattr(pairs, "NARROW", 1)
    means, cov = pairs.covariance(df, list("abc"))
    assert np.allclose(means, pdf.mean()) and np.allclose(cov, pdf.cov(), rtol=1e-9)
    assert np.allclose(pairs.correlations(df, list("abc")), pdf.corr(), rtol=1e-9)
    rows, g = pairs.gram(df, list("abc"))
    assert rows == 300 and np.allclose(g, pdf.to_numpy().T @ pdf.to_numpy())
    gaps = spark.createDataFrame(pdf.assign(a=pdf["a"].where(pdf.index % 3 != 0))) \
        .select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    assert np.allclose(pairs.correlations(gaps, list("abc")),
                       pdf.assign(a=pdf["a"].where(pdf.index % 3 != 0)).corr(), rtol=1e-9)


def test_lowest_by_hash_is_exact_on_ties(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 300, "a").otherwise("b"))
    for digits_quota in (0, 1, 7, 10_000):
        chosen = mark_lowest(df, "id", 42, lambda n: F.lit(digits_quota), "m", "g").where("m")
        got = {r["g"]: r["count"] for r in chosen.groupBy("g").count().collect()}
        assert got == {g: min(n, digits_quota) for g, n in (("a", 300), ("b", 200)) if digits_quota}


def test_normal_and_chi_square_quantiles(spark):
    p = [1e-9, 0.001, 0.02, 0.02425, 0.3, 0.5, 0.77, 0.98, 0.9999]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    got = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(v) for v in p], atol=1e-7)
    assert chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert chi_square_quantile(0.95, 5) == pytest.approx(11.070497693516351)


def test_normality_p_separates_shapes():
    rng = np.random.default_rng(5)

    def p(x):
        z = (x - x.mean()) / x.std()
        return normality_p(len(x), float((z ** 3).mean()), float((z ** 4).mean() - 3))

    assert p(rng.exponential(size=500)) < 1e-6
    assert np.mean([p(rng.normal(size=200)) <= 0.05 for _ in range(400)]) < 0.1


def log_likelihood(x, lam, kind):
    if kind == "box_cox":
        y, jac = (np.log(x) if abs(lam) < 1e-12 else (x ** lam - 1) / lam), np.log(x).sum()
    else:
        up, down = x[x >= 0], x[x < 0]
        y = np.concatenate([((up + 1) ** lam - 1) / lam if abs(lam) > 1e-12 else np.log1p(up),
                            -((1 - down) ** (2 - lam) - 1) / (2 - lam)])
        jac = (np.sign(x) * np.log1p(np.abs(x))).sum()
    return (lam - 1) * jac - len(x) / 2 * np.log(y.var())


@pytest.mark.parametrize("kind", ["box_cox", "yeo_johnson"])
def test_lambda_is_the_maximum_of_the_likelihood(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.gamma(2, 30, 800) + (0.1 if kind == "box_cox" else -20)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    lam = fit_lambdas(df, {"x": (kind, F.col("x"))})["x"]
    best = max(np.linspace(lam - 0.3, lam + 0.3, 6001), key=lambda v: log_likelihood(x, v, kind))
    assert lam == pytest.approx(best, abs=1e-4)
