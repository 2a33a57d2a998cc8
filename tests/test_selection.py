"""Selection of ranks in native types and in many groups, and what is built on it."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.functions import joins
from tabprep.functions import selection as S
from tabprep.functions.hashing import mark_lowest
from tabprep.operators.features import anova_f
from tabprep.operators.missing import fill_in_time
from tabprep.operators.profiling import box_stats, crosstab_counts
from tabprep.operators.sampling import (
    class_weights, sample_rows, smote, split_head, stratified_split, with_class_weights)

BIG = 1 << 53
COLUMNS = {
    "long": ("bigint", [BIG + 3, BIG + 1, BIG, BIG + 2, -BIG - 1, -BIG, None, 0, 0, (1 << 63) - 1, -(1 << 63)]),
    "short": ("smallint", [3, -3, 0, None, 5, 5, 5, -32768, 32767, 1, 2]),
    "wide": ("decimal(38,10)", [Decimal("1234567890123456789012345678.0000000001"), Decimal("1234567890123456789012345678"),
                                Decimal("-1234567890123456789012345678.0000000001"), Decimal("-1234567890123456789012345678"),
                                Decimal("0.0000000001"), Decimal("-0.0000000001"), Decimal(0), None, Decimal(10), Decimal(9), Decimal(-9)]),
    "real": ("double", [0.0, -0.0, 1e-320, -1e300, float("inf"), float("-inf"), float("nan"), None, 1.5, 1.5, -2.25]),
    "small": ("float", [0.5, -0.5, 3.25, float("nan"), None, 7.0, 7.0, -7.0, 0.0, 1.0, 2.0]),
    "text": ("string", ["b", "", "ab", "abc", "é", "z", None, "B", "b", "ab!", "ab "]),
    "day": ("date", [dt.date(2020, 1, k) for k in range(1, 10)] + [None, dt.date(1960, 5, 5)]),
    "time": ("timestamp", [dt.datetime(2020, 1, k, 3, 4, 5, k) for k in range(1, 10)] + [None, dt.datetime(1960, 5, 5)]),
    "local": ("timestamp_ntz", [dt.datetime(2020, 1, k, 3, 4, 5, k) for k in range(1, 10)] + [None, dt.datetime(1960, 5, 5)]),
    "flag": ("boolean", [True, False, None] * 3 + [True, False]),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_order_texts_sort_like_their_values(spark, name):
    kind, values = COLUMNS[name]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    rows = df.select("v", S.order_text(df, "v").alias("k")).collect()
    known = [r for r in rows if r["v"] is not None and r["v"] == r["v"]]
    assert all(r["k"] is None for r in rows if r not in known)
    raw = (lambda v: v.encode()) if kind == "string" else lambda v: v
    for a in known:
        for b in known:
            assert (a["k"] < b["k"]) == (raw(a["v"]) < raw(b["v"])) and (a["k"] == b["k"]) == (a["v"] == b["v"])


@pytest.mark.parametrize("finish", [0, 40, 100_000])
def test_ranks_of_many_groups(spark, monkeypatch, finish):
    monkeypatch.setattr(S, "DIGITS", 2)
    monkeypatch.setattr(S, "FINISH_ROWS", finish)
    monkeypatch.setattr(joins, "SALTS", 3)
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.4, 0, rng.integers(0, 300, 3000)),
                        "v": rng.integers(-50, 50, 3000) * rng.choice([1, 1 << 40], 3000)})
    pdf["g"] = pdf["g"].astype("Int64").where(pdf["g"] != 7)  # a group that is NULL
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g long, v long")
    keys = df.select("g", S.order_text(df, "v").alias("k"))
    wanted = keys.groupBy("g").agg(F.count("*").alias("n")).select("g", F.explode(F.expr("sequence(0, n)")).alias("rank"))
    text = {k: v for v, k in df.select("v", S.order_text(df, "v")).distinct().collect()}
    got = {(r["g"], r["rank"]): text[r["k"]] for r in S.select_ranks(keys, wanted).collect()}
    want = {(None if pd.isna(g) else int(g), i): int(v)
            for g, part in pdf.groupby("g", dropna=False) for i, v in enumerate(sorted(part["v"]))}
    assert got == want


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(0, 1e3, 4000).round(2), "g": np.where(np.arange(4000) < 1500, "hot", (np.arange(4000) % 900).astype(str))})
    pdf.loc[::17, "x"] = np.nan
    got = S.quantile_table(spark.createDataFrame(pdf), "x", [F.col("g").alias("name")], [0, 0.25, 0.5, 1]).collect()
    want = pdf.dropna().groupby("g")["x"]
    assert len(got) == want.ngroups
    for r in got:
        part = want.get_group(r["g"]["name"])
        assert r["n"] == len(part) and np.allclose([r["q0"], r["q1"], r["q2"], r["q3"]], part.quantile([0, 0.25, 0.5, 1]))


def test_head_beyond_doubles(spark):
    df = spark.range(100).select(F.col("id"), (F.lit(BIG) + F.col("id")).alias("key"), F.lit(1).alias("same"))
    for cutoff in (0, 1, 4, 99, 100, 1000):
        out = split_head(df.repartition(5), cutoff, "key").where("split = 'head'")
        assert sorted(r["id"] for r in out.collect()) == list(range(min(cutoff, 100)))
        out = split_head(df, cutoff, "same", "key").where("split = 'head'")
        assert sorted(r["id"] for r in out.collect()) == list(range(min(cutoff, 100)))
    gaps = df.withColumn("key", F.when(F.col("id") > 2, F.col("key")))
    assert [r["id"] for r in split_head(gaps, 1000, "key").where("split = 'tail'").collect()] == [0, 1, 2]


def test_split_of_fifty_thousand_classes(spark):
    df = spark.range(250_000).select("id", F.when(F.col("id") < 80_000, -1).otherwise(F.col("id") % 50_000).alias("c"))
    out = stratified_split(df, "c", "id", 0.25)
    sizes = out.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    assert sizes.count() == 50_001
    assert sizes.where(F.col("t") != F.floor(F.col("n") * 0.25 + 0.5)).isEmpty()
    assert sorted(out.where("split = 'test'").collect()) == sorted(
        stratified_split(df.repartition(7), "c", "id", 0.25).where("split = 'test'").collect())


def test_marks_need_distinct_keys_and_skip_null_groups(spark):
    df = spark.range(40).select((F.col("id") % 4).alias("id"), F.when(F.col("id") % 2 == 0, 1).alias("c"))
    with pytest.raises(ValueError, match="identify"):
        mark_lowest(df, "id", 1, lambda n: 3, "m").collect()
    one = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, 1).alias("c"))
    out = mark_lowest(one, "id", 1, lambda n: F.lit(3), "m", "c")
    assert out.where("m").count() == 3 and out.where("m and c is null").isEmpty() and out.count() == 40
    assert mark_lowest(one.where("id < 0"), "id", 1, lambda n: F.lit(3), "m", "c").isEmpty()
    assert sample_rows(one, "id", 100).count() == 40 and sample_rows(one, "id", 0).count() == 0 and sample_rows(one, "id", 7).count() == 7


def test_weights_and_scores_of_many_classes(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"c": rng.integers(0, 12_000, 40_000), "x": rng.normal(0, 1, 40_000)})
    pdf["x"] += pdf["c"] % 7
    df = spark.createDataFrame(pdf)
    weights = {r["class"]: r["weight"] for r in class_weights(df, "c").collect()}
    sizes = pdf["c"].value_counts()
    assert weights == pytest.approx({c: 40_000 / (len(sizes) * n) for c, n in sizes.items()})
    assert with_class_weights(df, "c").agg(F.sum("weight")).first()[0] == pytest.approx(40_000)
    groups = pdf.groupby("c")["x"]
    between = (groups.size() * (groups.mean() - pdf["x"].mean()) ** 2).sum() / (len(sizes) - 1)
    within = ((pdf["x"] - groups.transform("mean")) ** 2).sum() / (40_000 - len(sizes))
    assert anova_f(df, ["x"], "c")["x"] == pytest.approx(between / within)
    assert anova_f(df.where("c < 0"), ["x"], "c") == {"x": None}


def test_box_of_many_groups_and_long_counts(spark):
    df = spark.range(60_000).select((F.col("id") % 15_000).alias("g"), (F.col("id") % 7919).cast("double").alias("x"))
    out = box_stats(df, "x", "g")
    assert out.count() == 15_000
    assert box_stats(df.withColumn("x", F.lit(float("nan"))), "x", "g").isEmpty()
    assert crosstab_counts(df, "g", "x").agg(F.sum("count")).first()[0] == 60_000


def test_fill_along_a_text_column_at_any_size(spark, monkeypatch):
    from tabprep.functions import running
    rows = [(f"t{k:04d}", k, float(k) if k % 9 == 0 else None) for k in range(500)] + [(None, 500, None), (None, 501, 7.0)]
    df = spark.createDataFrame(rows, "t string, k long, v double").repartition(4)
    want = {k: (7.0 if k == 501 else 495.0 if k == 500 else k // 9 * 9.0) for k in range(502)}
    for limit in (1_000_000, 40):
        monkeypatch.setattr(running, "ROWS_PER_BUCKET", limit)
        assert {r["k"]: r["v"] for r in fill_in_time(df, "t", "k", ["v"]).collect()} == want


def test_many_copies_of_few_rows(spark, monkeypatch):
    from tabprep.operators import sampling
    monkeypatch.setattr(sampling, "COPIES_PER_BLOCK", 50)
    df = spark.range(2003).select("id", F.col("id").cast("double").alias("x"), F.when(F.col("id") < 3, 1).otherwise(0).alias("y"))
    made = smote(df, "y", 1, "id").where("synthetic = 1")
    assert made.count() == 1997 and made.where("x < 0 or x > 2").isEmpty() and made.distinct().count() > 1900
