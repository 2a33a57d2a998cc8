"""The cell tree and the neighbour search against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.functions import cells
from tabprep.functions import neighbours as N


def points(rng, n, features, gaps=0.0, values=12, first=0):
    x = rng.integers(0, values, (n, features)).astype(float)
    x[rng.random(x.shape) < gaps] = np.nan
    return pd.DataFrame(x, columns=[f"f{j}" for j in range(features)]).assign(id=np.arange(first, first + n))


def frame(spark, pdf, parts=4):
    rows = [[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in pdf.to_numpy(dtype=object).tolist()]
    kinds = ", ".join(f"{c} {'long' if c == 'id' else 'double'}" for c in pdf.columns)
    return spark.createDataFrame([[int(v) if c == "id" else v for c, v in zip(pdf.columns, r)] for r in rows],
                                 kinds).repartition(parts)


def expected(q, d, features, k):
    """(id, donor, squared distance) of the nearest, by a loop over features in the order of the operator."""
    out = set()
    a, b, ids = q[features].to_numpy(), d[features].to_numpy(), d["id"].to_numpy()
    for row, name in zip(a, q["id"]):
        away = (row - b) ** 2
        used = (~np.isnan(away)).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.nansum(away, 1) * len(features) / used
        order = [i for i in np.lexsort((ids, far)) if used[i]][:k]
        out |= {(int(name), int(ids[i]), round(float(far[i]), 6)) for i in order}
    return out


def found(df):
    return {(r.id, r.donor, round(r.dist2, 6)) for r in df.collect()}


@pytest.mark.parametrize("share", [1_000_000, 0])
@pytest.mark.parametrize("features, gaps, values", [(4, 0.3, 6), (2, 0.6, 3)])
def test_cells_equal_brute_force(spark, monkeypatch, share, features, gaps, values):
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 25)
    monkeypatch.setattr(cells, "CHILDREN", 6)
    monkeypatch.setattr(cells, "SHARED_NUMBERS", share)
    monkeypatch.setattr(cells, "ROWS_PER_CHUNK", 30)
    rng = np.random.default_rng(features)
    d, q = points(rng, 500, features, gaps, values), points(rng, 60, features, gaps, values, 1000)
    names = [f"f{j}" for j in range(features)]
    donors = frame(spark, d).withColumn("payload", F.col("id") * 2)
    got = N.nearest(frame(spark, q), donors, names, 4, plan="cells")
    assert found(got) == expected(q, d, names, 4)
    assert got.where("payload <> donor * 2").isEmpty()


def test_shared_equals_cells_with_many_patterns(spark, monkeypatch):
    """Twelve columns with independent gaps: nearly every row has a combination of its own."""
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 100)
    rng = np.random.default_rng(1)
    names = [f"f{j}" for j in range(12)]
    d, q = points(rng, 3000, 12, 0.3, 9), points(rng, 200, 12, 0.3, 9, 9000)
    assert d[names].isna().drop_duplicates().shape[0] > 1000
    donors = frame(spark, d).withColumn("payload", F.col("id"))
    shared = found(N.nearest(frame(spark, q), donors, names, 5, plan="shared"))
    assert shared == expected(q, d, names, 5)
    assert found(N.nearest(frame(spark, q), donors, names, 5, plan="cells")) == shared


def test_one_search_for_several_columns(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 40)
    rng = np.random.default_rng(4)
    names = ["f0", "f1", "f2"]
    d = points(rng, 400, 3, 0.3, 15)
    asked = pd.concat([d[d[c].isna()].assign(want=float(j)) for j, c in enumerate(names)])
    q = frame(spark, asked).withColumn("want", F.col("want").cast("int"))
    for plan in ("shared", "cells"):
        got = N.nearest(q, frame(spark, d), names, 3, payloads=names, plan=plan).collect()
        for j, c in enumerate(names):
            mine = {(r.id, r.donor, round(r.dist2, 6)) for r in got if r.want == j}
            assert mine == expected(d[d[c].isna()], d[d[c].notna()], names, 3)
            by_id = d.set_index("id")[c]
            assert all(r.payload == by_id[r.donor] for r in got if r.want == j)


def test_equal_points_nan_and_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 10)
    same = spark.range(200).select("id", F.lit(1.0).alias("f0"), F.lit(float("nan")).alias("f1"), F.col("id").alias("payload"))
    q = spark.range(300, 320).select("id", F.lit(2.0).alias("f0"), F.lit(5.0).alias("f1"))
    got = N.nearest(q, same, ["f0", "f1"], 3, plan="cells")
    assert found(got) == {(i, k, 2.0) for i in range(300, 320) for k in range(3)}
    for left, right in ((q.where("id < 0"), same), (q, same.where("id < 0"))):
        assert N.nearest(left, right, ["f0", "f1"], 3, plan="cells").isEmpty()
        assert N.nearest(left, right, ["f0", "f1"], 3).isEmpty()
    assert N.nearest(q.withColumn("f0", F.lit(None).cast("double")), same, ["f0", "f1"], 3, plan="cells").isEmpty()


def test_few_cells_are_searched(spark, monkeypatch):
    """Five equally wide continuous features, where slabs along one of them would not help."""
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 150)
    features = [f"f{j}" for j in range(5)]
    d = spark.range(30_000).select("id", *[F.rand(j).alias(f) for j, f in enumerate(features)], F.col("id").alias("payload"))
    q = spark.range(500).select("id", *[F.rand(50 + j).alias(f) for j, f in enumerate(features)])
    trace: dict = {}
    got = found(N.nearest(q, d, features, 5, plan="cells", trace=trace))
    assert got == found(N.nearest(q, d, features, 5, plan="shared"))
    assert trace["cells"] > 200 and trace["searched"] / trace["queries"] < 0.25 * trace["cells"]


def test_cells_are_bounded_and_boxes_exact(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS_PER_CELL", 30)
    monkeypatch.setattr(cells, "CHILDREN", 5)
    rng = np.random.default_rng(7)
    d = points(rng, 2000, 3, 0.2, 1000)
    d.loc[:900, "f0"] = 5.0  # a frequent value
    d["f2"] = np.arange(2000.0)  # no two points are equal
    placed, boxes, depth = cells.cell_tree(frame(spark, d), ["f0", "f1", "f2"])
    got, table = placed.toPandas(), boxes.toPandas().set_index("cell")
    assert len(got) == 2000 and depth > 1 and got.groupby("cell").size().max() <= 30
    for cell, part in got.groupby("cell"):
        box = table.loc[cell]
        assert box["n"] == len(part)
        for f in ("f0", "f1", "f2"):
            assert box[f"c_{f}"] == part[f].notna().sum()
            if box[f"c_{f}"]:
                assert (box[f"lo_{f}"], box[f"hi_{f}"]) == (part[f].min(), part[f].max())


def test_a_sample_without_differences_is_cut_by_the_exact_box():
    one = np.array([[1.0, np.nan]] * 8)
    cuts = cells.median_cuts(one, 4, 100, np.array([100, 0]), np.array([1.0, np.nan]), np.array([9.0, np.nan]))
    assert cuts.leaves(np.array([[1.0, np.nan], [9.0, np.nan]])).tolist() == [1, 2]
    cuts = cells.median_cuts(one[:0], 4, 100, np.array([100, 3]), np.array([1.0, 2.0]), np.array([1.0, 2.0]))
    assert len(set(cuts.leaves(np.array([[1.0, np.nan], [1.0, 2.0]])))) == 2
    assert cells.median_cuts(one, 4, 100, np.array([100, 0]), np.array([1.0, np.nan]), np.array([1.0, np.nan])) is None


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n, features = rng.integers(1, 8), rng.integers(1, 5)
        d = points(rng, n, features, rng.choice([0, 0.4]), 9)[[f"f{j}" for j in range(features)]]
        q = points(rng, 20, features, 0.3, 9).to_numpy()[:, :features].astype(float)
        row = {"n": n, **{f"c_{f}": d[f].notna().sum() for f in d}, **{f"lo_{f}": d[f].min() for f in d},
               **{f"hi_{f}": d[f].max() for f in d}}
        bounds = cells.Boxes(pd.DataFrame([row]), list(d)).bounds(q)[:, 0]
        assert (bounds <= N._distances(q, d.to_numpy()).min(1)).all()


def test_cells_are_not_cut_by_what_no_query_has(spark):
    # the wanted column is the widest feature; cut by it, every query would have to search all of its slices
    rng = np.random.default_rng(5)
    donors = pd.DataFrame({"id": np.arange(30_000), "v": rng.integers(0, 100_000, 30_000).astype(float),
                           "a": rng.integers(0, 3_000, 30_000).astype(float)})
    asked = pd.DataFrame({"id": np.arange(200), "want": 0, "v": np.nan, "a": rng.integers(0, 3_000, 200).astype(float)})
    trace: dict = {}
    queries = spark.createDataFrame(asked, "id long, want int, v double, a double")
    found = N.nearest(queries, spark.createDataFrame(donors, "id long, v double, a double"), ["v", "a"], 5, ["v"], "cells", trace)
    got = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist2", "donor"))).alias("near")).collect()
    assert trace["cells"] > 5 and trace["searched"] < 2 * trace["queries"]
    for r in got:
        far = (donors["a"] - asked["a"][r.id]) ** 2 * 2
        want = sorted(zip(far, donors["id"], strict=True))[:5]
        assert [(x.dist2, x.donor) for x in r.near] == want
    assert len(got) == 200
