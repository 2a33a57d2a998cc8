"""Operators on small frames with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.base import Fitted
from tabprep.functions import running as R
from tabprep.operators import encoding as EN
from tabprep.operators.collinear import MulticollinearityReducer, prune_correlated
from tabprep.operators.distribution import DistributionTransformer
from tabprep.operators.encoding import CategoricalEncoder
from tabprep.operators.features import FeatureCreator, FeatureSelector, PrincipalComponents
from tabprep.operators.missing import MissingValueHandler, fill_in_time
from tabprep.operators.modelling import FittedLogistic, LogisticTrainer, train
from tabprep.operators.outliers import IsolationForest, OutlierDetector
from tabprep.operators.scaling import FeatureScaler
from tabprep.operators.schema import align_schema
from tabprep.plans.auto import AutoScaler, AutoTransform
from tabprep.plans.chain import FittedChain, StepChain, options_from
from tabprep.plans.six_step import STEPS, six_step_chain
from tabprep.sources import readers, writers
from tabprep.sources.storage import fresh_path
from tabprep.streaming.scoring import read_stream, score_stream


#: Shops: takings (one unknown, one with a slipped decimal point), floor space, Sunday opening, district, size, closed since.
SHOPS = [(31.0, "yes", "north", "small", 0), (44.0, "no", "east", "large", 1), (None, "no", "north", "middle", 0),
         (52.0, "yes", "west", "large", 0), (39.0, "no", "east", "small", 0), (47.0, "no", "north", "middle", 1),
         (58.0, "yes", None, "large", 0), (9000.0, "no", "west", "middle", 0), (36.0, "no", "north", "small", 0),
         (41.0, "yes", "south", "small", 1), (55.0, "no", "east", "large", 0), (49.0, "no", "south", "middle", 0)]
SIZES = ["small", "middle", "large"]


@pytest.fixture(scope="module")
def shops(spark):
    rows = [(takings, 3.0 + k * k / 2, *rest) for k, (takings, *rest) in enumerate(SHOPS)]
    return spark.createDataFrame(rows, "takings double, space double, sunday string, district string, size string, closed int")


def test_missing_handler_fills_and_flags(shops):
    fitted = MissingValueHandler().fit(shops, "closed")
    out = fitted.transform(shops).toPandas()
    assert out["takings"][2] == 47.0 and out["district"][6] == "north"
    assert out["takings_Missing_Flag"].sum() == out["takings_Missing_Flag"][2] == 1
    assert out.notna().all().all()
    again = Fitted.from_json(fitted.to_json()).transform(shops).toPandas()
    pd.testing.assert_frame_equal(out, again)


def test_missing_handler_rejects_bad_settings():
    with pytest.raises(ValueError):
        MissingValueHandler("nonsense")
    with pytest.raises(ValueError):
        MissingValueHandler(drop_high_missing_threshold=2)


def test_outlier_row_is_flagged_removed_and_clipped(shops):
    frame = shops.na.fill(47.0, ["takings"])
    only = {"columns": ["takings"]}
    flagged = OutlierDetector(**only).fit(frame).transform(frame).toPandas()
    assert flagged.index[flagged["Outlier_Flag"] == 1].tolist() == [7]
    kept = OutlierDetector(handling="remove", **only).fit_transform(frame)
    assert kept.count() == len(SHOPS) - 1 and kept.agg(F.max("takings")).first()[0] == 58
    # quartiles 40.5 and 52.75
    assert OutlierDetector(handling="clip", **only).fit_transform(frame).agg(F.max("takings")).first()[0] == 52.75 + 1.5 * 12.25
    for bad in ({"method": "guess"}, {"handling": "ignore"}, {"factor": 0}):
        with pytest.raises(ValueError):
            OutlierDetector(**bad)


def test_constant_and_short_columns_get_no_bounds(spark):
    frame = spark.range(20).select(F.lit(1.0).alias("one"), F.when(F.col("id") < 5, F.col("id").cast("double")).alias("few"),
                                   F.col("id").cast("double").alias("x"))
    assert list(OutlierDetector().fit(frame).bounds) == ["x"]


def test_isolation_forest_finds_the_tails(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), [60.0, -70.0]])
    frame = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "x": x}))
    out = IsolationForest("x", "k").fit(frame).transform(frame).toPandas()
    assert out.loc[out["x"].abs() > 50, "x_Outlier_Flag"].all()
    # above the interpolated 95% quantile of the scores lie at most ceil(0.05 * n) rows
    assert 90 < out["x_Outlier_Flag"].sum() <= 151
    assert not out.loc[out["x"].abs() < 0.5, "x_Outlier_Flag"].any()


def test_scalers_and_inverse(spark):
    frame = spark.range(50).select((F.col("id") * F.col("id")).cast("double").alias("x"), F.lit(3.0).alias("c"))
    for method in ("standard", "minmax", "robust"):
        fitted = FeatureScaler(method).fit(frame)
        out = fitted.inverse_transform(fitted.transform(frame)).toPandas()
        assert np.allclose(out["x"], out["x_original"]) and np.allclose(out["c_original"], 3.0)
        if method == "standard":
            assert abs(out["x_scaled"].mean()) < 1e-9 and out["x_scaled"].std(ddof=0) == pytest.approx(1)
    with pytest.raises(ValueError):
        FeatureScaler("log")


def test_distribution_inverse_and_quantile_shape(spark):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame(pd.DataFrame({"x": rng.lognormal(1, 1, 2000)}))
    for method in ("log", "box_cox", "yeo_johnson"):
        fitted = DistributionTransformer(method).fit(frame)
        assert np.allclose(fitted.inverse_transform(fitted.transform(frame)).toPandas(), frame.toPandas())
    z = DistributionTransformer("quantile").fit_transform(frame).toPandas()["x"]
    assert abs(z.mean()) < 0.02 and abs(z.clip(-4, 4).std() - 1) < 0.03
    assert (z.rank() == frame.toPandas()["x"].rank()).all()
    with pytest.raises(ValueError):
        DistributionTransformer("nonsense")


def test_fill_in_time_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 40)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"t": rng.integers(0, 60, 600), "k": rng.permutation(600), "p": rng.integers(0, 3, 600)})
    pdf.loc[:250, "t"] = 30
    pdf["v"] = np.where(rng.random(600) < 0.06, rng.random(600), np.nan)
    frame = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    want = pdf.sort_values(["t", "k"])
    whole = want.assign(v=want["v"].ffill().bfill()).sort_values("k")["v"].to_numpy()
    got = fill_in_time(frame, "t", "k", ["v"]).toPandas().sort_values("k")["v"].to_numpy()
    assert np.array_equal(got, whole)
    parts = want.assign(v=want.groupby("p")["v"].transform(lambda s: s.ffill().bfill())).sort_values("k")["v"].to_numpy()
    got = fill_in_time(frame, "t", "k", ["v"], ["p"]).toPandas().sort_values("k")["v"].to_numpy()
    assert np.array_equal(got, parts, equal_nan=True)


def test_encoder_kinds_and_values(shops):
    fitted = CategoricalEncoder(ordinal_features_map={"size": SIZES}).fit(shops, "closed")
    assert fitted.kinds == {"sunday": "binary", "district": "onehot", "size": "ordinal"}
    out = fitted.transform(shops).toPandas()
    assert out["size"].tolist() == [SIZES.index(r[3]) for r in SHOPS]
    assert out["sunday"].tolist() == [int(r[1] == "yes") for r in SHOPS]
    marks = {v: f"district_{v}" for v in ("east", "north", "south", "west", "nan")}
    assert [c for c in out if c.startswith("district_")] == list(marks.values())
    for k, r in enumerate(SHOPS):
        assert out.loc[k, list(marks.values())].sum() == out.loc[k, marks[r[2] or "nan"]] == 1
    again = Fitted.from_json(fitted.to_json()).transform(shops).toPandas()
    pd.testing.assert_frame_equal(out, again)


def test_encoder_errors_on_unknown(spark, shops):
    fitted = CategoricalEncoder(handle_unknown="error").fit(shops.select("sunday"))
    other = spark.createDataFrame([("sometimes",)], "sunday string")
    with pytest.raises(Exception, match="unknown category"):
        fitted.transform(other).collect()


def test_category_table_beyond_the_parameter_limit(spark, monkeypatch):
    monkeypatch.setattr(EN, "MAX_PARAMETER_ROWS", 10)
    frame = spark.range(300).select((F.col("id") % 30).cast("string").alias("c"))
    fitted = EN.fit_frequency(frame, "c")
    assert fitted.shares.table is not None
    assert {r["c"] for r in fitted.transform(frame).collect()} == {10 / 300}
    codes = EN.category_codes(frame, "c", "code").distinct().toPandas().sort_values("c")
    assert codes["code"].tolist() == list(range(30))


def test_inflation_against_least_squares(spark):
    rng = np.random.default_rng(8)
    width, depth = rng.uniform(1, 9, 60), rng.uniform(1, 9, 60)
    pdf = pd.DataFrame({"width": width, "depth": depth, "edge": width + depth + rng.normal(0, 0.3, 60), "price": rng.uniform(0, 50, 60)})
    fitted = MulticollinearityReducer().fit(spark.createDataFrame(pdf))

    def inflation(names):
        out = {}
        for c in names:
            rest = pdf[[n for n in names if n != c]].to_numpy()
            miss = pdf[c] - rest @ np.linalg.lstsq(rest, pdf[c], rcond=None)[0]
            out[c] = (pdf[c] ** 2).sum() / (miss ** 2).sum()
        return out

    left = list(pdf)
    for seen in fitted.history:
        assert seen == pytest.approx(inflation(left))
        left = [c for c in left if c != max(seen, key=seen.get) or max(seen.values()) <= 5]
    assert sorted(fitted.selected) == sorted(left) and fitted.dropped[0]["reason"] == "high VIF"
    exact = MulticollinearityReducer().fit(spark.createDataFrame(pdf.assign(edge=pdf["width"] * 3)))
    assert exact.dropped[0] == {"feature": "width", "value": float("inf"), "reason": "high VIF"}
    for bad in ({"vif_threshold": 0.5}, {"max_iter": 0}, {"corr_threshold": 2}, {"handle_missing": "x"}):
        with pytest.raises(ValueError):
            MulticollinearityReducer(**bad)


@pytest.mark.parametrize("seed", range(20))
def test_pruning_takes_one_of_each_group(seed):
    rng = np.random.default_rng(seed)
    names = [f"c{k}" for k in range(7)]
    corr = np.corrcoef(rng.normal(size=(7, 4)))
    importance = dict(zip(names, rng.random(7), strict=True)) if seed % 2 else None
    left, dropped = prune_correlated(names, corr, 0.6, importance)
    strength = lambda a, b: abs(corr[names.index(a), names.index(b)])
    stay, want = list(names), []
    for c in names:
        partners = [o for o in stay if o != c and strength(c, o) > 0.6] if c in stay else []
        if partners:
            group = [c, *partners]
            mean = {g: np.mean([strength(g, o) for o in group]) for g in group}
            worst = min(group, key=importance.get) if importance else max(group, key=mean.get)
            want.append((worst, pytest.approx(max(strength(worst, o) for o in group if o != worst))))
            stay.remove(worst)
    assert left == stay and [(d["feature"], d["value"]) for d in dropped] == want


def test_features_need_a_target_and_rules_are_callable(shops):
    with pytest.raises(ValueError):
        FeatureSelector().fit(shops)
    with pytest.raises(ValueError):
        FeatureCreator().add_rule("x", "not callable")
    out = PrincipalComponents(0.99).fit(shops.select("takings", "space"))
    assert len(out.axes) == 1 and max(out.axes[0], key=abs) > 0


def test_six_steps_save_load_and_subset(spark, shops):
    chain = six_step_chain({"size": SIZES})
    fitted = chain.fit(shops, "closed")
    out = fitted.transform(shops)
    assert out.columns[-1] == "closed" and out.count() == len(SHOPS)
    path = fresh_path(spark, "test-chain")
    fitted.save(shops, path)
    loaded = FittedChain.load(spark, path)
    pd.testing.assert_frame_equal(loaded.transform(shops).toPandas(), out.toPandas())
    assert set(fitted.stages(shops)) == {"input", *STEPS, "output"}
    assert "takings_Missing_Flag" in fitted.stages(shops, STEPS[:1])["missing_handler"].columns
    with pytest.raises(ValueError, match="no step named"):
        fitted.transform(shops, ["nonsense"])
    with pytest.raises(ValueError, match="no rows"):
        chain.fit(shops.limit(0), "closed")


def test_fit_does_not_depend_on_partitions(shops):
    one, many = (MissingValueHandler().fit(shops.repartition(n)).to_dict() for n in (1, 7))
    assert one == many


def test_chain_from_settings(shops):
    steps = options_from({"fill": {"step": "MissingValueHandler", "numeric_strategy": "mean"},
                          "scale": {"step": "FeatureScaler", "method": "minmax", "in_place": True}})
    out = StepChain(steps).fit(shops, "closed").transform(shops).toPandas()
    assert out["takings"].between(0, 1).all()


def test_transform_stays_lazy_on_a_stream(spark, shops):
    path = fresh_path(spark, "test-stream")
    shops.write.parquet(path)
    fitted = six_step_chain().fit(shops, "closed")
    stream = score_stream(read_stream(spark, path, shops.schema), fitted)
    assert stream.isStreaming and stream.columns == fitted.transform(shops).columns


def test_logistic_training_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (x @ [1.5, -1.0] + rng.logistic(size=400) > 0.8).astype(int)
    frame = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    fitted = LogisticTrainer().fit(frame, "y")
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    design, beta = np.column_stack([x, np.ones(400)]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        penalty = np.diag([1.0, 1.0, 0.0])
        beta -= np.linalg.solve((design.T * (w * p * (1 - p))) @ design + penalty,
                                design.T @ (w * (p - y)) + penalty @ beta)
    assert np.allclose([*fitted.coefficients[0], fitted.intercepts[0]], beta, atol=1e-4)
    with pytest.raises(ValueError, match="features are absent"):
        fitted.predict(frame.drop("a"))


def test_any_spark_estimator_can_be_trained(shops):
    from pyspark.ml.classification import DecisionTreeClassifier
    frame = shops.na.fill(0.0)
    model = train(frame, ["takings", "space"], "closed", DecisionTreeClassifier(seed=1))
    assert model.numFeatures == 2


def test_several_classes(spark):
    frame = spark.range(300).select((F.col("id") % 3).alias("y"), (F.col("id") % 3 * 2.0).alias("x"))
    fitted = LogisticTrainer().fit(frame, "y")
    out = fitted.transform(frame).toPandas()
    assert (out["prediction"] == out["y"]).all()
    assert np.allclose(out[[f"probability_{i}" for i in range(3)]].sum(axis=1), 1)


def test_schema_alignment_of_awkward_names(spark):
    frame = spark.createDataFrame([(1.5, "x")], "`LOR ` double, `a.b` string")
    out = align_schema(frame, [{"name": "LOR ", "dtype": "int64"}, {"name": "a.b", "dtype": "float64"},
                               {"name": "ok", "dtype": "bool"}])
    assert out.first().asDict() == {"LOR ": 1, "a.b": 0.0, "ok": False}


def test_auto_steps_reject_gaps(shops):
    for step in (AutoScaler(), AutoTransform()):
        with pytest.raises(ValueError, match="missing or infinite"):
            step.fit(shops)


def test_readers(spark, tmp_path):
    (tmp_path / "towns.csv").write_text("town,people \nUlm,126\nBern,134\nGent,263\n")
    (tmp_path / "towns.txt").write_text("town\tpeople\nUlm\t126\nBern\t134\n")
    (tmp_path / "towns.json").write_text('[{"town": "Ulm", "people": 126}, {"town": "Bern"}, {"people": 263}]')
    (tmp_path / "nothing.csv").write_text("")
    read = lambda name, **options: readers.load_table(spark, str(tmp_path / name), **options)
    assert read("towns.csv").columns == ["town", "people "] and read("towns.csv").count() == 3
    assert sorted(r["town"] for r in read("towns.txt").collect()) == ["Bern", "Ulm"]
    assert {(r["town"], r["people"]) for r in read("towns.json", records_array=True).collect()} == {
        ("Ulm", 126), ("Bern", None), (None, 263)}
    with pytest.raises(ValueError, match="holds no rows"):
        read("nothing.csv")
    with pytest.raises(ValueError, match="no reader for"):
        read("towns.xyz")
    with pytest.raises(FileNotFoundError):
        read("villages.csv")
    texts = spark.createDataFrame([('quote " and, comma', None), ("", "line\nbreak")], "a string, b string")
    path = writers.write_csv(texts, str(tmp_path / "out"))
    back = readers.read_csv(spark, path, texts.schema, multiline=True)
    # in text files an empty field is a missing value
    assert {tuple(r) for r in back.collect()} == {('quote " and, comma', None), (None, "line\nbreak")}


def test_models_predict_without_spark_ml(spark):
    model = FittedLogistic(["x"], [[2.0]], [0.0])
    frame = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    got = [r["probability_1"] for r in model.predict_proba(frame).collect()]
    assert got == [pytest.approx(0.5), pytest.approx(1 / (1 + np.exp(-2)))]
