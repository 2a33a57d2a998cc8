"""Constant columns, NaN and many classes."""

import math

import pytest
from pyspark.sql import functions as F

from tabprep.functions.moments import profile
from tabprep.functions.pairs import correlations
from tabprep.operators.outliers import simple_bounds
from tabprep.operators.profiling import pair_correlation
from tabprep.operators.sampling import smote


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") * -2.0).alias("y"), F.lit(0.1).alias("c"))


def test_correlation_with_a_constant_column(frame):
    assert pair_correlation(frame, "x", "c").first()["corr"] is None
    assert pair_correlation(frame, "x", "y").first()["corr"] == -1.0
    table = correlations(frame, ["x", "y", "c"])
    assert math.isnan(table[0][2]) and table[0][1] == pytest.approx(-1)


def test_constant_column_has_no_outliers(frame):
    assert simple_bounds("zscore", 3.0, ["c"]).fit(frame).bounds == {}


def test_nan_is_missing_in_measures(frame):
    with_nan = frame.withColumn("x", F.when(F.col("x") == 7, float("nan")).otherwise(F.col("x")))
    seen = profile(with_nan, ["x"], ["n", "max", "mean"])["x"]
    assert seen["n"] == 199 and seen["max"] == 199


def test_smote_with_many_classes(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 20, "rare").when(F.col("id") < 120, "often").otherwise(
        F.concat(F.lit("k"), F.col("id").cast("string"))).alias("t"), F.col("id").cast("double").alias("f"))
    assert smote(rows, "t", "rare", "id", ["f"]).where("synthetic = 1").count() == 80
