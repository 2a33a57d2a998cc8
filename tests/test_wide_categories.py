"""One-hot vectors of any width, inferred codes and labels beyond the old limits, against brute force."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabprep.base import load_fitted, save_fitted
from tabprep.operators import encoding as EN
from tabprep.operators.modelling import LogisticTrainer
from tabprep.plans.chain import FittedChain
from tabprep.plans.six_step import six_step_chain
from tabprep.sources.storage import fresh_path


def places(df, vector):
    """{row id: place that is set, or -1}, with the width of the vectors."""
    spot = F.array_position(vector_to_array(vector), 1.0).cast("int") - 1
    rows = df.select("id", spot.alias("p"), F.size(vector_to_array(vector)).alias("w"), F.aggregate(
        vector_to_array(vector), F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(r["s"] == (r["p"] >= 0) for r in rows)
    return {r["id"]: r["p"] for r in rows}, {r["w"] for r in rows}


def test_fifty_thousand_categories_through_six_steps(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 97).cast("double").alias("x"),
                                    F.format_string("k%05d", (F.col("id") * 7) % 50_000).alias("c"))
    chain = six_step_chain()
    fitted = chain.fit(df.select("x", "c"))
    out = fitted.stages(df.select("x", "c"))["encoder"]
    assert "c_onehot" in out.columns and out.schema["c_onehot"].dataType.typeName() == "vectorudt"
    vector = fitted.steps["encoder"].vectors["c"]
    assert vector.size == 50_000
    few = df.where("id % 1500 = 3")
    got, widths = places(vector.add(few, "c", "v"), "v")
    assert widths == {50_000} and got == {i: (i * 7) % 50_000 for i in range(3, 60_000, 1500)}
    path = fresh_path(spark, "test-wide-chain")
    fitted.save(df, path)
    again = FittedChain.load(spark, path).transform(df.select("x", "c").limit(50))
    assert again.columns == fitted.transform(df.select("x", "c").limit(50)).columns and again.columns[-1] == "c_onehot"


@pytest.mark.parametrize("limit", [3, 1_000])
def test_vectors_have_the_places_of_the_columns(spark, monkeypatch, limit):
    monkeypatch.setattr(EN, "MAX_ONE_HOT", limit)
    rows = [(0, "b"), (1, "a"), (2, None), (3, "d"), (4, "c"), (5, "a")]
    df = spark.createDataFrame(rows, "id long, c string")
    fitted = EN.CategoricalEncoder(max_cardinality=None).fit(df)
    new = spark.createDataFrame([*rows, (6, "zzz")], "id long, c string")
    out = fitted.transform(new)
    if limit == 3:
        got, widths = places(out, "c_onehot")
        assert widths == {5} and fitted.cardinality["c"] == 4
    else:
        marks = ["c_a", "c_b", "c_c", "c_d", "c_nan"]
        got = {r["id"]: [r[m] for m in marks].index(1) if any(r[m] for m in marks) else -1 for r in out.collect()}
    assert got == {0: 1, 1: 0, 2: 4, 3: 3, 4: 2, 5: 0, 6: -1}
    strict = EN.CategoricalEncoder(max_cardinality=None, handle_unknown="error").fit(df)
    with pytest.raises(Exception, match="unknown category"):
        strict.transform(new).collect()
    assert strict.transform(df).count() == 6
    dummies = EN.encode_dummies(df, "c")
    if limit == 3:
        assert dummies.columns == ["id", "c_dummies"] and places(dummies, "c_dummies") == (
            {0: 0, 1: -1, 2: -1, 3: 2, 4: 1, 5: -1}, {3})
    else:
        assert dummies.columns == ["id", "c_b", "c_c", "c_d"]


def test_inferred_codes_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(EN, "MAX_ONE_HOT", 5)
    monkeypatch.setattr(EN, "MAX_PARAMETER_ROWS", 10)
    df = spark.range(200).select("id", F.when(F.col("id") % 20 != 0, F.format_string("%03d", F.col("id") % 20)).alias("c"))
    fitted = EN.CategoricalEncoder({"c": "ordinal"}).fit(df)
    path = fresh_path(spark, "test-ordinal")
    save_fitted(fitted, spark, path)
    more = df.union(spark.createDataFrame([(900, "new")], "id long, c string"))
    got = {r["id"]: r["c"] for r in load_fitted(spark, path).transform(more).collect()}
    assert got == {**{i: None if i % 20 == 0 else float(i % 20 - 1) for i in range(200)}, 900: -1.0}


def test_labels_beyond_a_thousand(spark):
    df = spark.range(3000).select((F.col("id") % 1200).alias("y"), F.sin("id").alias("a"))
    fitted = LogisticTrainer(max_iter=1).fit(df, "y")
    assert fitted.labels == list(range(1200)) and len(fitted.coefficients) == 1200
    words = spark.range(60).select(F.when(F.col("id") < 30, "no").otherwise("yes").alias("y"), F.col("id").cast("double").alias("a"))
    assert LogisticTrainer().fit(words, "y").predict(words).where("prediction <> y").count() <= 2
