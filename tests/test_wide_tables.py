"""Tables with very many keys and vectors with very many places stay off the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabprep.functions import selection
from tabprep.functions.joins import salted_join
from tabprep.operators.encoding import CategoryVector
from tabprep.sources.storage import stored


def test_the_copies_of_a_side_table_count_before_it_is_broadcast(spark):
    table = stored(spark.range(300_000).select((F.col("id") % 300_000).cast("string").alias("k"), F.lit(1.0).alias("v")), "side")
    rows = spark.range(1_000).select("id", (F.col("id") * 7).cast("string").alias("c"))
    joined = salted_join(rows, table, ["c"], ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert joined.agg(F.count("*"), F.sum("v")).first()[:] == (1_000, 1_000.0)


def test_a_wide_vector_has_no_name_for_each_place(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") > 0, F.format_string("k%04d", F.col("id"))).alias("c"))
    out = CategoryVector.learn(df, "c", nulls=True).add(df, "c", "v")
    assert len(out.schema["v"].metadata["ml_attr"]) == 1 and out.schema["v"].metadata["ml_attr"]["num_attrs"] == 3_000
    got = {r["id"]: r["v"] for r in out.select("id", "v").where("id % 500 = 0").collect()}
    assert {i: (v.size, v.indices.tolist(), v.values.tolist()) for i, v in got.items()} == {
        i: (3_000, [i - 1 if i else 2_999], [1.0]) for i in range(0, 3_000, 500)}
    unseen = CategoryVector.learn(df, "c").add(spark.createDataFrame([("x",), (None,)], "c string"), "c", "v")
    assert [(r["v"].size, r["v"].indices.tolist()) for r in unseen.collect()] == [(2_999, []), (2_999, [])]


def test_groups_that_fit_a_window_are_counted_without_sorting_texts(spark, monkeypatch):
    rows = spark.range(4_000).select(F.struct((F.col("id") % 40).alias("c")).alias("g"),
                                     (F.col("id") * 37 % 401).cast("double").alias("x"))
    plans = []
    monkeypatch.setattr(selection, "stored", lambda df, label="table": plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or stored(df, label))
    found = selection.quantile_table(rows.select("g.c", "x"), "x", [F.col("c")], [0.25, 0.5]).collect()
    assert not any("SortAggregate" in p for p in plans)
    for r in found:
        values = [i * 37 % 401 for i in range(r["g"]["c"], 4_000, 40)]
        assert r["n"] == 100 and [r["q0"], r["q1"]] == list(np.quantile(values, [0.25, 0.5]))


def test_points_of_a_cell_lie_side_by_side(spark, monkeypatch):
    from tabprep.functions import cells
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 100)
    points = spark.range(4_000).select("id", (F.col("id") * 37 % 401).cast("double").alias("x")).coalesce(2)
    placed, _, depth = cells.cell_tree(points, ["x"])
    runs = placed.select("cell", F.input_file_name().alias("file")).toPandas()
    assert depth and all(part["cell"].is_monotonic_increasing for _, part in runs.groupby("file"))
