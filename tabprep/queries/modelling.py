"""Training, scoring, metrics, whole preparations."""

from pyspark.sql import functions as F

from tabprep.operators import evaluation as E
from tabprep.operators.features import FeatureCreator, row_sum
from tabprep.operators.missing import MissingValueHandler
from tabprep.operators.modelling import FittedLogistic, LogisticTrainer
from tabprep.operators.modelling import score_batch as score_rows
from tabprep.operators.outliers import OutlierDetector
from tabprep.operators.scaling import FeatureScaler, FittedScaler
from tabprep.plans.chain import FittedChain, StepChain, options_from
from tabprep.plans.six_step import six_step_chain
from tabprep.queries.registry import null_when, query, rounded, table
from tabprep.sources.storage import fresh_path
from tabprep.streaming.scoring import read_stream, score_stream, write_stream

MODEL = FittedLogistic(["l_quantity", "l_discount"], [[0.05, -8.0]], [-0.75])
_MARGIN = "(-0.75 + (l_quantity * 0.05 + l_discount * -8.0))"
_P = f"(1.0 / (1.0 + exp(-{_MARGIN})))"


def lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def _newton_sql(step):
    """One Newton step for two weights and an intercept: the penalised weighted gradient, and its 3 x 3 system by determinants."""
    sums = ", ".join(f"sum(s * q * {a} * {b}) AS h{i}{j}" for i, a in enumerate(("x", "z", "1")) for j, b in enumerate(("x", "z", "1")) if i <= j)
    h = [[f"(h{min(i, j)}{max(i, j)}" + (" + 1)" if i == j < 2 else ")") for j in range(3)] for i in range(3)]

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    moves = [f"{w} - {det([[f'g{i}' if j == k else h[i][j] for j in range(3)] for i in range(3)])} / {det(h)} AS {w}"
             for k, w in enumerate(("u", "v", "b"))]
    return f"""
t{step + 1} AS (SELECT {', '.join(moves)} FROM (
  SELECT u, v, b, u + sum(s * (p - y) * x) AS g0, v + sum(s * (p - y) * z) AS g1, sum(s * (p - y)) AS g2, {sums}
  FROM (SELECT *, p * (1 - p) AS q FROM (SELECT e.*, t.*, 1 / (1 + exp(-(u * x + v * z + b))) AS p FROM e, t{step} t)) GROUP BY u, v, b))"""


@query("train_logreg", f"""
WITH r AS (SELECT value / 100 AS x, user_id / 150.0::DOUBLE AS z, (event_type = 'error')::INT AS y FROM events),
     e AS (SELECT r.*, (SELECT count(*)::DOUBLE FROM r) / (2 * n) AS s FROM r JOIN (SELECT y, count(*) AS n FROM r GROUP BY y) USING (y)),
     t0 AS (SELECT 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS b),{','.join(_newton_sql(k) for k in range(8))}
SELECT 'value' AS feature, round(u, 4) AS weight FROM t8 UNION ALL SELECT 'share', round(v, 4) FROM t8
UNION ALL SELECT 'intercept', round(b, 4) FROM t8""")
def train_logreg(spark, sf):
    frame = table(spark, sf, "events").select(
        (F.col("value") / 100).alias("value"), (F.col("user_id") / 150).alias("share"),
        (F.col("event_type") == "error").cast("int").alias("y"))
    model = LogisticTrainer().fit(frame, "y")
    rows = [*zip(model.features, model.coefficients[0], strict=True), ("intercept", model.intercepts[0])]
    return spark.createDataFrame([(c, round(float(w), 4)) for c, w in rows], "feature string, weight double")


@query("predict", f"""SELECT *, ({_P} >= 0.5)::INTEGER AS prediction FROM (
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem)""")
def predict(spark, sf):
    return MODEL.predict(lines(spark, sf))


@query("predict_proba", f"""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round(1.0 - {_P}, 9) AS probability_0,
    round({_P}, 9) AS probability_1 FROM lineitem""")
def predict_proba(spark, sf):
    return rounded(MODEL.predict_proba(lines(spark, sf)), 9, ["probability_0", "probability_1"])


SCHEMA = [{"name": "l_quantity", "dtype": "float64"}, {"name": "l_discount", "dtype": "float64"},
          {"name": "l_linenumber", "dtype": "int64"}, {"name": "absent", "dtype": "float64"}]
_SCORED = f"""
WITH c AS (SELECT CASE WHEN l_linenumber = 2 THEN 0.0 ELSE (l_quantity - 25.0) / 10.0 END AS l_quantity, l_discount,
                  l_linenumber::BIGINT AS l_linenumber, 0.0::DOUBLE AS absent FROM lineitem)
SELECT *, ({_P} >= 0.5)::INTEGER AS "Prediction", round(1.0 - {_P}, 9) AS "Prob_0", round({_P}, 9) AS "Prob_1" FROM c"""


def _scored(frame):
    broken = frame.withColumn("l_quantity", F.when(F.col("l_linenumber") == 2, F.lit(float("inf")))
                              .otherwise(F.col("l_quantity")))
    scaler = FittedScaler({"l_quantity": 25.0}, {"l_quantity": 10.0}, in_place=True)
    return rounded(score_rows(broken, SCHEMA, MODEL, scaler), 9, ["Prob_0", "Prob_1"])


@query("score_batch", _SCORED)
def score_batch(spark, sf):
    return _scored(lines(spark, sf))


@query("score_stream", f"""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, ({_P} >= 0.5)::INTEGER AS prediction,
       round(1.0 - {_P}, 9) AS probability_0, round({_P}, 9) AS probability_1 FROM lineitem""")
def score_stream_query(spark, sf):
    source = fresh_path(spark, "stream-in")
    lines(spark, sf).repartition(4).write.parquet(source)
    stream = read_stream(spark, source, lines(spark, sf).schema, files_per_trigger=2)
    out = fresh_path(spark, "stream-out")
    write_stream(score_stream(stream, MODEL), out, fresh_path(spark, "stream-state")).awaitTermination()
    return rounded(spark.read.parquet(out), 9, ["probability_0", "probability_1"])


_SCORES = """
s AS (SELECT least(value / 500, 1.0) AS score, (event_type = 'click')::INTEGER AS y FROM events),
g AS (SELECT score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


def scores(spark, sf):
    return table(spark, sf, "events").select(
        F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), (F.col("event_type") == "click").cast("int").alias("y"))


@query("roc_curve", f"""WITH {_SCORES}
SELECT score AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def roc_curve(spark, sf):
    return rounded(E.roc_curve(scores(spark, sf), "y", "score"), 9, ["fpr", "tpr"])


@query("auc", f"""WITH {_SCORES},
t AS (SELECT fp / n AS x, tp / p AS y, lag(fp / n, 1, 0.0) OVER (ORDER BY score DESC) AS x0,
             lag(tp / p, 1, 0.0) OVER (ORDER BY score DESC) AS y0 FROM c)
SELECT round(sum((x - x0) * (y + y0) / 2), 9) AS auc FROM t""")
def auc(spark, sf):
    return rounded(E.auc(scores(spark, sf), "y", "score"), 9)


@query("pr_curve", f"""WITH {_SCORES}
SELECT score AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM c
UNION ALL SELECT NULL, 1.0, 0.0""")
def pr_curve(spark, sf):
    return rounded(E.pr_curve(scores(spark, sf), "y", "score"), 9, ["precision", "recall"])


@query("best_threshold", f"""WITH {_SCORES},
m AS (SELECT score, tp / p - fp / n AS j, 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-6) AS f FROM c)
SELECT (SELECT score FROM m ORDER BY j DESC, score DESC LIMIT 1) AS threshold_j, round(max(j), 9) AS youden_j,
       (SELECT score FROM m ORDER BY f DESC, score LIMIT 1) AS threshold_f1, round(max(f), 9) AS f1 FROM m""")
def best_threshold(spark, sf):
    return rounded(E.best_threshold(scores(spark, sf), "y", "score"), 9, ["youden_j", "f1"])


_CUT = """(SELECT (event_type = 'click')::INTEGER AS y, (least(value / 500, 1.0) >= 0.1)::INTEGER AS predicted FROM events)"""


@query("threshold_predict", """SELECT least(value / 500, 1.0) AS score, (event_type = 'click')::INTEGER AS y,
    (least(value / 500, 1.0) >= 0.1)::INTEGER AS predicted FROM events""")
def threshold_predict(spark, sf):
    return E.threshold_predict(scores(spark, sf), "score", 0.1)


@query("confusion_matrix", f"""SELECT y AS actual, predicted, count(*) AS "count" FROM {_CUT} GROUP BY 1, 2""")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(E.threshold_predict(scores(spark, sf), "score", 0.1), "y", "predicted")


@query("classification_report", f"""
WITH c AS (SELECT k::VARCHAR AS class, sum((y = k)::INT) AS support, sum((predicted = k)::INT) AS named,
                  sum((y = k AND predicted = k)::INT) AS hits FROM {_CUT}, (VALUES (0), (1)) v(k) GROUP BY k),
     m AS (SELECT class, hits / named AS p, hits / support AS r, support::BIGINT AS support, hits FROM c),
     f AS (SELECT *, 2 * p * r / (p + r) AS f FROM m),
     t AS (SELECT sum(support)::BIGINT AS n FROM f)
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), n FROM f, t GROUP BY n
UNION ALL SELECT 'weighted avg', round(sum(p * support) / n, 9), round(sum(r * support) / n, 9), round(sum(f * support) / n, 9), n
          FROM f, t GROUP BY n
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / n, 9), n FROM f, t GROUP BY n
UNION ALL SELECT 'balanced accuracy', NULL, NULL, round(avg(r), 9), n FROM f, t GROUP BY n
UNION ALL SELECT 'f1 of class 1', NULL, NULL, round(f, 9), n FROM f, t WHERE class = '1'""")
def classification_report(spark, sf):
    predicted = E.threshold_predict(scores(spark, sf), "score", 0.1)
    return rounded(E.classification_report(predicted, "y", "predicted"), 9)


def mixed(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        null_when(k % 10 == 0, "value").alias("value"), (F.col("user_id") / 150).alias("share"),
        F.when(k % 2 == 0, F.col("value")).alias("half"), "event_type", (k % 2).cast("int").alias("y"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


def _six_sql(kinds):
    marks = ", ".join(f"(event_type = '{k}')::INT::DOUBLE AS event_type_{k}" for k in kinds)
    return f"""
WITH g AS (SELECT CASE WHEN event_id % 10 <> 0 THEN value END AS v, user_id / 150.0::DOUBLE AS share, event_type,
                  (event_id % 2)::INTEGER AS y FROM events),
     i AS (SELECT coalesce(v, (SELECT median(v) FROM g)) AS v, (v IS NULL)::INT AS miss, share, event_type, y FROM g),
     b AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(share, 0.25) AS s1,
                  quantile_cont(share, 0.75) AS s3 FROM i),
     f AS (SELECT ln(1 + v) AS lv, share, miss, (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))::INT AS o,
                  (share < s1 - 1.5 * (s3 - s1) OR share > s3 + 1.5 * (s3 - s1))::INT AS so, event_type, y FROM i, b),
     s AS (SELECT avg(lv) AS a1, stddev_pop(lv) AS d1, avg(share) AS a2, stddev_pop(share) AS d2, avg(miss) AS a3,
                  stddev_pop(miss) AS d3, avg(o) AS a4, stddev_pop(o) AS d4 FROM f)
SELECT round((lv - a1) / d1, 6) AS value_log, round((share - a2) / d2, 6) AS share,
       round((o - a4) / d4, 6) AS "value_Outlier_Flag", so AS "share_Outlier_Flag",
       round((miss - a3) / d3, 6) AS "value_Missing_Flag_Outlier_Flag", {marks}, y FROM f, s"""


@query("six_steps", _six_sql(_KINDS))
def six_steps(spark, sf):
    frame = mixed(spark, sf)
    return rounded(six_step_chain().fit(frame, "y").transform(frame))


@query("six_steps_wide", """
WITH o AS (SELECT o_custkey, o_totalprice FROM orders),
     k AS (SELECT 'c' || o_custkey AS name, (row_number() OVER (ORDER BY 'c' || o_custkey) - 1)::INTEGER AS place FROM (SELECT DISTINCT o_custkey FROM orders)),
     q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, median(o_totalprice) AS m, avg(o_totalprice) AS a FROM o)
SELECT place, count(*) AS n, (SELECT count(*) FROM k)::INTEGER AS size FROM o JOIN k ON k.name = 'c' || o_custkey, q GROUP BY place""")
def six_steps_wide(spark, sf):
    """One-hot with a category for each customer: a sparse vector. Counts how often each place of it is set."""
    frame = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"), "o_totalprice")
    out = six_step_chain(one_hot="vector").fit(frame).transform(frame)
    vector = F.unwrap_udt("customer_onehot")  # its sparse parts: an array would hold a number for each customer in each row
    place = F.coalesce(F.get(vector["indices"], F.lit(0)), F.lit(-1))
    return out.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.max(vector["size"]).alias("size"))


@query("six_steps_subset", _six_sql(_KINDS).rsplit("SELECT round((lv", 1)[0] + f"""
SELECT 0.0::DOUBLE AS value_log, round(share, 6) AS share, o AS "value_Outlier_Flag", so AS "share_Outlier_Flag",
       miss AS "value_Missing_Flag_Outlier_Flag", {', '.join(f'0.0::DOUBLE AS event_type_{k}' for k in _KINDS)}, y FROM f""")
def six_steps_subset(spark, sf):
    """Only the first two steps; final columns made by later steps are filled with 0.0."""
    frame = mixed(spark, sf)
    fitted = six_step_chain().fit(frame, "y")
    return rounded(fitted.transform(frame, ["missing_handler", "outlier_detector"]))


@query("custom_steps", """
WITH g AS (SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, l_extendedprice AS e, l_returnflag AS y FROM lineitem),
     m AS (SELECT l_orderkey, coalesce(q, (SELECT avg(q) FROM g)) AS q, e, y FROM g),
     b AS (SELECT avg(q) - stddev_samp(q) AS qlo, avg(q) + stddev_samp(q) AS qhi, avg(e) - stddev_samp(e) AS elo,
                  avg(e) + stddev_samp(e) AS ehi FROM m),
     c AS (SELECT greatest(least(q, qhi), qlo) AS q, greatest(least(e, ehi), elo) AS e, y FROM m, b),
     r AS (SELECT min(q) AS q0, max(q) AS q1, min(e) AS e0, max(e) AS e1 FROM c)
SELECT round((q - q0) / (q1 - q0), 6) AS q, round((e - e0) / (e1 - e0), 6) AS e,
       round((q - q0) / (q1 - q0) + (e - e0) / (e1 - e0), 6) AS sum_features, y FROM c, r""")
def custom_steps(spark, sf):
    frame = table(spark, sf, "lineitem").select(
        null_when(F.col("l_linenumber") == 3, "l_quantity").alias("q"), F.col("l_extendedprice").alias("e"),
        F.col("l_returnflag").alias("y"))
    steps = [("missing", MissingValueHandler("mean", add_missing_flag=False)),
             ("outliers", OutlierDetector("zscore", 1.0, "clip", robust=False)),
             ("scale", FeatureScaler("minmax", in_place=True)),
             ("create", FeatureCreator({"sum_features": row_sum}))]
    fitted = StepChain(steps).fit(frame, "y")
    path = fresh_path(spark, "chain")
    fitted.save(frame, path)
    return rounded(FittedChain.load(spark, path).transform(frame))


# two columns of equal weight after scaling that rise together: the first principal axis is their sum
@query("custom_steps_features", """
WITH l AS (SELECT l_quantity AS q, l_extendedprice + 5000 * l_quantity AS e, l_returnflag AS y FROM lineitem),
     s AS (SELECT (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS q, (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS e, y FROM l)
SELECT round((q + e) / sqrt(2.0::DOUBLE), 6) AS "PC_1", y FROM s""")
def custom_steps_features(spark, sf):
    """Fill, scale, select by variance, principal axis: from settings alone, saved and loaded."""
    frame = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("q"), (F.col("l_extendedprice") + F.col("l_quantity") * 5000).alias("e"), F.col("l_discount").alias("d"),
        F.col("l_returnflag").alias("y"))
    steps = options_from({
        "missing": {"step": "MissingValueHandler", "numeric_strategy": "mean"},
        "scale": {"step": "FeatureScaler", "columns": ["q", "e"], "in_place": True},
        "regression": {"step": "RegressionImputer", "column": "q"},
        "create": {"step": "FeatureCreator", "rules": ["max_feature"], "columns": ["q"]},
        "select": {"step": "FeatureSelector", "strategy": "variance", "threshold": 0.9, "columns": ["q", "e", "d"]},
        "axes": {"step": "PrincipalComponents", "n_components": 1}})
    path = fresh_path(spark, "chain")
    StepChain(steps).fit(frame, "y").save(frame, path)
    return rounded(FittedChain.load(spark, path).transform(frame))
