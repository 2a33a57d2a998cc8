"""Isolation forest: samples of the trees, and scores recomputed in SQL from the table of trees."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.base import load_fitted, read_side_table, save_fitted
from tabprep.operators.outliers import IsolationForest, tree_samples
from tabprep.sources.storage import fresh_path


def test_trees_draw_their_samples_independently(spark):
    rows, trees, sample = 20_000, 60, 200
    known = spark.range(rows).select(F.col("id").cast("double").alias("v"), F.col("id").alias("key"))
    got = tree_samples(known, rows, trees, sample, 7).toPandas()
    sets = got.groupby("tree")["v"].apply(set)
    assert len(sets) == trees and (got.groupby("tree").size() == sample).all() and all(len(s) == sample for s in sets)
    shared = [len(sets[a] & sets[b]) for a in range(trees) for b in range(a)]
    expected = sample * sample / rows  # 2 of 200, as for independent draws; one common pool would share far more
    assert abs(np.mean(shared) - expected) < 0.15 and max(shared) < 12
    assert abs(got["v"].mean() - rows / 2) < 4 * rows / math.sqrt(12 * len(got))
    again = tree_samples(known.repartition(9), rows, trees, sample, 7).toPandas()
    key = ["tree", "v"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))
    other = tree_samples(known, rows, trees, sample, 8).toPandas().groupby("tree")["v"].apply(set)
    assert len(sets[0] & other[0]) < 12


@pytest.mark.parametrize("rows", [0, 1, 5, 300])
def test_small_tables_enter_every_tree(spark, rows):
    known = spark.range(rows).select(F.col("id").cast("double").alias("v"), F.col("id").alias("key"))
    got = tree_samples(known, rows, 10, 256, 1).toPandas()
    assert len(got) == 10 * min(rows, 256)
    frame = known.select("key", F.col("v").alias("x"))
    out = IsolationForest("x", "key", trees=10).fit(frame).transform(frame)
    assert out.count() == rows


def test_scores_recomputed_from_the_tree_table(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": np.arange(4000), "x": np.append(rng.normal(0, 1, 3900), rng.normal(0, 8, 100)).round(2)})
    pdf.loc[::50, "x"] = np.nan
    frame = spark.createDataFrame(pdf).repartition(4)
    fitted = IsolationForest("x", "k", trees=40, sample=128).fit(frame)
    trees = read_side_table(spark, fitted.trees).toPandas()  # noqa: F841
    assert trees.groupby("tree")["start"].min().eq(-math.inf).all() and trees["tree"].nunique() == 40
    mean_path = 2 * (math.log(127) + np.euler_gamma) - 2 * 127 / 128
    want = duckdb.sql(f"""
        WITH s AS (SELECT tree, start, coalesce(lead(start) OVER (PARTITION BY tree ORDER BY start), 'infinity') AS ends, length FROM trees),
             p AS (SELECT k, 2.0 ** (-avg(length) / {mean_path}) AS score FROM pdf, s
                   WHERE NOT isnan(x) AND x >= start AND x < ends GROUP BY k)
        SELECT k, (score > (SELECT quantile_cont(score, 0.95) FROM p) + 1e-9)::INT AS flag FROM p""").df().set_index("k")["flag"]
    got = fitted.transform(frame).toPandas().set_index("k")["x_Outlier_Flag"]
    assert got[pdf["x"].isna().to_numpy()[got.index]].sum() == 0
    near = got.loc[want.index]
    assert (near != want).sum() <= 3 and near.sum() > 100  # scores at the cut itself may round either way
    path = fresh_path(spark, "test-forest")
    save_fitted(fitted, spark, path)
    assert load_fitted(spark, path).transform(frame).toPandas().set_index("k")["x_Outlier_Flag"].equals(got)
