"""Fitted nearest-neighbour imputation, missing values as NaN, and steps saved with their tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.base import Fitted, load_fitted, save_fitted
from tabprep.functions import neighbours as N
from tabprep.operators import encoding as EN
from tabprep.operators.missing import (
    KnnImputer, KnnVoter, MissingValueHandler, RegressionImputer, impute_knn, missing_profile)
from tabprep.operators.outliers import OutlierDetector
from tabprep.operators.scaling import FeatureScaler
from tabprep.plans.chain import FittedChain, StepChain
from tabprep.sources.storage import discard, fresh_path, stored


def brute(donors, rows, columns, k):
    out = rows.copy()
    for i, row in rows.iterrows():
        for c in columns:
            if np.isnan(row[c]):
                able = donors[donors[c].notna()]
                away = (able[columns] - row[columns]) ** 2
                used = away.notna().sum(axis=1)
                far = (away.sum(axis=1) * len(columns) / used.where(used > 0)).to_numpy()
                order = [j for j in np.lexsort((able["id"], far)) if np.isfinite(far[j])][:k]
                out.loc[i, c] = able[c].to_numpy()[order].mean() if order else donors[c].mean()
    return out


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(0)
    x = pd.DataFrame(rng.integers(0, 9, (260, 3)).astype(float), columns=["a", "b c", "d.e"])
    x[rng.random(x.shape) < 0.25] = np.nan
    x.loc[258:, :] = np.nan
    x["id"] = np.arange(260)
    return x[:200], x[200:]


def spark_frame(spark, pdf, nan):
    frame = spark.createDataFrame(pdf).repartition(3)
    return frame if nan else frame.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c != "id" else c
                                            for c in pdf.columns])


@pytest.mark.parametrize("nan", [True, False])
@pytest.mark.parametrize("plan", ["auto", "cells"])
def test_knn_fills_another_table(spark, tables, plan, nan):
    train, other = tables
    columns = ["a", "b c", "d.e"]
    fitted = KnnImputer(columns, columns, 3, "id", plan).fit(spark_frame(spark, train, nan))
    got = fitted.transform(spark_frame(spark, other, nan)).toPandas().sort_values("id", ignore_index=True)
    want = brute(train, other, columns, 3).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    own = fitted.transform(spark_frame(spark, train, nan)).toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(own[want.columns], brute(train, train, columns, 3), check_dtype=False)


def test_knn_strategy_in_a_saved_chain(spark, tables):
    train, other = tables
    chain = StepChain([("missing", MissingValueHandler("knn", knn_neighbors=3, key="id"))])
    fitted = chain.fit(spark_frame(spark, train, False))
    want = fitted.transform(spark_frame(spark, other, False)).toPandas().sort_values("id", ignore_index=True)
    plain = want.drop(columns=[c for c in want if c.endswith("_Missing_Flag")])
    pd.testing.assert_frame_equal(plain[other.columns], brute(train, other, ["a", "b c", "d.e"], 3).reset_index(drop=True),
                                  check_dtype=False)
    assert want["a_Missing_Flag"].tolist() == other["a"].isna().astype(int).tolist()
    path = fresh_path(spark, "test-knn-chain")
    fitted.save(spark_frame(spark, train, False), path)
    discard(spark, fitted.steps["missing"].knn.donors.removeprefix("side-table:"))  # the scratch table is gone
    again = FittedChain.load(spark, path).transform(spark_frame(spark, other, False)).toPandas()
    pd.testing.assert_frame_equal(again.sort_values("id", ignore_index=True), want)
    report = {r["column"]: r for r in FittedChain.load(spark, path).steps["missing"].report(spark_frame(spark, other, True)).collect()}
    assert report["a"]["missing_before"] == other["a"].isna().sum() and report["a"]["missing_after"] == 0
    assert report["a"]["method"] == "knn"


def test_a_chain_searches_neighbours_once(spark, tables, monkeypatch):
    """Later fits read the stored rows; the fitted chain stays lazy and gives the same as its steps one by one."""
    from tabprep.plans import chain as C
    kept = []
    monkeypatch.setattr(C, "stored", lambda df, label: kept.append(label) or stored(df, label))
    train = spark_frame(spark, tables[0], False)
    steps = [("missing", MissingValueHandler("knn", knn_neighbors=3, key="id")), ("scale", FeatureScaler(columns=["a"], in_place=True)),
             ("outliers", OutlierDetector(columns=["a"]))]
    fitted = StepChain(steps).fit(train)
    assert kept == ["chain"]
    one = MissingValueHandler("knn", knn_neighbors=3, key="id").fit_transform(train)
    two = FeatureScaler(columns=["a"], in_place=True).fit(one)
    assert two.centers["a"] == pytest.approx(fitted.steps["scale"].centers["a"])
    assert StepChain(steps[:1]).fit(train).steps["missing"].costly and len(kept) == 1
    assert StepChain(steps[1:]).fit(one) and len(kept) == 1


def test_knn_without_key_features_or_rows(spark, tables):
    train = spark_frame(spark, tables[0], False)
    filled = KnnImputer(["a"], ["b c", "d.e"], 3).fit_transform(train)
    assert filled.where("a is null").isEmpty() and filled.count() == 200
    assert KnnImputer(["a"], ["b c"], 3, "id").fit(train).transform(train.where("id < 0")).isEmpty()
    assert KnnImputer(["a"], ["b c"], 3, "id").fit(train.where("id < 0")).transform(train).where("a is null").count() \
        == tables[0]["a"].isna().sum()
    assert impute_knn(train.select("id"), "id").columns == ["id"]


def test_knn_strategy_compares_only_columns_with_gaps(spark):
    rows = [(k, None if k == 3 else float(k), 100.0 * (k == 9)) for k in range(10)]
    frame = spark.createDataFrame(rows, "id long, x double, whole double")
    fitted = MissingValueHandler("knn", key="id").fit(frame)
    assert fitted.knn.features == ["x"]  # as there is nothing to compare by, the mean fills
    assert fitted.transform(frame).where("id = 3").first()["x"] == sum(k for k in range(10) if k != 3) / 9


@pytest.mark.parametrize("plan", ["auto", "cells"])
def test_votes_for_another_table(spark, plan):
    rng = np.random.default_rng(5)
    kinds, colours = np.array(["ant", "bee", "cat"]), np.array(["blue", "green", "red"])
    pdf = pd.DataFrame({"id": np.arange(300), "x": rng.integers(0, 12, 300).astype(float), "colour": colours[rng.integers(0, 3, 300)]})
    pdf["kind"] = kinds[(pdf["x"] // 4).astype(int).to_numpy()]
    pdf.loc[rng.random(300) < 0.2, "x"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "kind"] = None
    rows = lambda p: [tuple(None if v is None or v != v else v for v in r) for r in p.itertuples(index=False)]
    frame = spark.createDataFrame(rows(pdf), "id long, x double, colour string, kind string")
    train, other = frame.where("id < 200"), frame.where("id >= 200").union(
        spark.createDataFrame([(900, 1.0, "mauve", None), (901, None, "mauve", None)], frame.schema))
    fitted = KnnVoter("kind", ["x", "colour"], 4, "id", plan).fit(train)
    path = fresh_path(spark, "test-vote")
    save_fitted(fitted, spark, path)
    got = {r["id"]: r["kind"] for r in load_fitted(spark, path).transform(other).collect()}
    donors = [(r["id"], r["x"], float(list(colours).index(r["colour"])), r["kind"]) for r in train.where("kind is not null").collect()]
    for r in other.collect():
        if r["kind"] is not None:
            assert got[r["id"]] == r["kind"]
            continue
        place = float(list(colours).index(r["colour"])) if r["colour"] in colours else None
        far = []
        for i, x, c, kind in donors:
            both = [(a - b) ** 2 for a, b in ((r["x"], x), (place, c)) if a is not None and b is not None]
            if both:
                far.append((sum(both) * 2 / len(both), i, kind))
        near = [kind for _, _, kind in sorted(far)[:4]]
        assert got[r["id"]] == (min(near, key=lambda v: (-near.count(v), v)) if near else None)
    assert got[901] is None and fitted.transform(other.where("id < 0")).isEmpty()


def test_nan_is_missing_everywhere(spark):
    frame = spark.range(1001).select("id", F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("id") % 10).alias("x"),
                                     F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("id") * 2.0).alias("y"))
    assert missing_profile(frame, ["x"]).first()["missing_count"] == 1
    for strategy in ("mean", "median", "most_frequent", "constant"):
        fitted = MissingValueHandler(strategy).fit(frame)
        out = fitted.transform(frame)
        assert fitted.nulls["x"] == 1 and out.where("isnan(x) or x is null").isEmpty()
        assert out.where("x_Missing_Flag = 1").count() == 1
        assert {r["column"]: (r["missing_before"], r["missing_after"]) for r in fitted.report(frame).collect()}["x"] == (1, 0)
    assert RegressionImputer("y", 0.5, ["id"]).fit(frame).transform(frame).where("id = 7").first()["y"] == pytest.approx(14)


def test_regression_without_predictors_changes_nothing(spark):
    frame = spark.range(30).select(F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("z"))
    for step in (RegressionImputer("y", 0.5), RegressionImputer("x", 0.5, ["z"]), RegressionImputer("x", 0.5, [])):
        chain = StepChain([("regression", step)]).fit(frame)
        assert chain.transform(frame).collect() == frame.collect()


def test_category_tables_are_saved_with_the_step(spark, monkeypatch):
    monkeypatch.setattr(EN, "MAX_PARAMETER_ROWS", 10)
    frame = spark.range(600).select(F.when(F.col("id") < 400, "hot").otherwise((F.col("id") % 50).cast("string")).alias("c"),
                                    (F.col("id") % 7).cast("double").alias("y"))
    for strategy in ("frequency", "target"):
        fitted = EN.CategoricalEncoder(max_cardinality=5, high_cardinality_strategy=strategy).fit(frame, "y")
        want = sorted(map(tuple, fitted.transform(frame).collect()))
        path = fresh_path(spark, "test-encoder")
        save_fitted(fitted, spark, path)
        discard(spark, fitted.maps["c"].table.removeprefix("side-table:"))
        assert sorted(map(tuple, load_fitted(spark, path).transform(frame).collect())) == want
    long = spark.createDataFrame([("k" * 100_000,), ("x",)], "c string")
    assert EN.fit_frequency(long, "c").shares.table is not None  # few categories, but not small
    assert isinstance(Fitted.from_json(EN.fit_frequency(frame.limit(3), "c").to_json()), EN.FittedFrequency)


def test_donors_go_to_every_task_only_if_small(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARED_BYTES", 100)
    wide = spark.range(50).select("id", F.col("id").cast("double").alias("f0"))
    assert N._few(wide, wide) is None
    monkeypatch.setattr(N, "SHARED_BYTES", 10_000)
    assert N._few(wide, wide).num_rows == 50
