"""Outlier operators."""

from pyspark.sql import functions as F

from tabprep.operators.outliers import IsolationForest, OutlierDetector, simple_bounds
from tabprep.plans.auto import outlier_auto as auto_outliers
from tabprep.queries.registry import null_when, query, rounded, table

_EVENTS = """(SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value, user_id::DOUBLE AS user_id
              FROM events)"""
_IQR = f"""
b AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
             quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi,
             quantile_cont(user_id, 0.25) - 1.5 * (quantile_cont(user_id, 0.75) - quantile_cont(user_id, 0.25)) AS ulo,
             quantile_cont(user_id, 0.75) + 1.5 * (quantile_cont(user_id, 0.75) - quantile_cont(user_id, 0.25)) AS uhi
      FROM {_EVENTS})"""
_OUT = "coalesce(value < lo OR value > hi, false)"


def events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", null_when(F.col("event_id") % 10 == 0, "value").alias("value"),
        F.col("user_id").cast("double").alias("user_id"))


def fitted(spark, sf, **settings):
    frame = events(spark, sf)
    return frame, OutlierDetector(**{"columns": ["value", "user_id"], **settings}).fit(frame)


def bounds_table(spark, model):
    return spark.createDataFrame(
        [(c, float(lo), float(hi)) for c, (lo, hi) in model.bounds.items()],
        "column string, lower_bound double, upper_bound double")


def _bounds_sql(lower, upper, columns=("value", "user_id"), source=_EVENTS):
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round({lower.format(c=c)}, 6) AS lower_bound,
       round({upper.format(c=c)}, 6) AS upper_bound FROM {source}""" for c in columns)


_Q1, _Q3 = "quantile_cont({c}, 0.25)", "quantile_cont({c}, 0.75)"


@query("outlier_bounds_iqr", _bounds_sql(f"{_Q1} - 1.5 * ({_Q3} - {_Q1})", f"{_Q3} + 1.5 * ({_Q3} - {_Q1})"))
def outlier_bounds_iqr(spark, sf):
    return rounded(bounds_table(spark, fitted(spark, sf)[1]))


@query("outlier_bounds_iqr_per_column", _bounds_sql(
    f"{_Q1} - 3.0 * ({_Q3} - {_Q1})", f"{_Q3} + 3.0 * ({_Q3} - {_Q1})", ["value"]) + " UNION ALL " + _bounds_sql(
    f"{_Q1} - 1.5 * ({_Q3} - {_Q1})", f"{_Q3} + 1.5 * ({_Q3} - {_Q1})", ["user_id"]))
def outlier_bounds_iqr_per_column(spark, sf):
    return rounded(bounds_table(spark, fitted(spark, sf, factor={"value": 3.0})[1]))


@query("outlier_bounds_zscore", _bounds_sql("avg({c}) - 3 * stddev_samp({c})", "avg({c}) + 3 * stddev_samp({c})"))
def outlier_bounds_zscore(spark, sf):
    return rounded(bounds_table(spark, fitted(spark, sf, method="zscore", factor=3.0, robust=False)[1]))


@query("outlier_bounds_robust_z", _bounds_sql("median({c}) - 3 * mad({c})", "median({c}) + 3 * mad({c})"))
def outlier_bounds_robust_z(spark, sf):
    return rounded(bounds_table(spark, fitted(spark, sf, method="zscore", factor=3.0)[1]))


@query("outlier_bounds_simple", f"""
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM {_EVENTS})
SELECT event_id, value, user_id, coalesce(value < m - 2 * d OR value > m + 2 * d, false)::INTEGER AS "value_Outlier_Flag"
FROM {_EVENTS}, s""")
def outlier_bounds_simple(spark, sf):
    frame = events(spark, sf)
    return simple_bounds("zscore", 2.0, ["value"]).fit(frame).transform(frame)


@query("outlier_mahalanobis", f"""
WITH k AS (SELECT * FROM {_EVENTS} WHERE value IS NOT NULL),
     s AS (SELECT avg(value) AS mx, avg(user_id) AS my, var_samp(value) AS a, covar_samp(value, user_id) AS b,
                  var_samp(user_id) AS d FROM k)
SELECT event_id, value, user_id, coalesce(
    ((value - mx) ** 2 * d - 2 * (value - mx) * (user_id - my) * b + (user_id - my) ** 2 * a) / (a * d - b * b)
    > -2 * ln(1 - 0.999), false)::INTEGER AS "Outlier_Flag" FROM {_EVENTS}, s""")
def outlier_mahalanobis(spark, sf):
    frame, model = fitted(spark, sf, method="mahalanobis", probability=0.999)
    return model.transform(frame)


@query("outlier_flag", f"""WITH {_IQR}
SELECT event_id, value, user_id, ({_OUT} OR user_id < ulo OR user_id > uhi)::INTEGER AS "Outlier_Flag"
FROM {_EVENTS}, b""")
def outlier_flag(spark, sf):
    frame, model = fitted(spark, sf)
    return model.transform(frame)


@query("outlier_flag_columns", f"""WITH {_IQR}
SELECT event_id, value, user_id, {_OUT}::INTEGER AS "value_Outlier_Flag",
       (user_id < ulo OR user_id > uhi)::INTEGER AS "user_id_Outlier_Flag" FROM {_EVENTS}, b""")
def outlier_flag_columns(spark, sf):
    frame, model = fitted(spark, sf, handling="flag_columns")
    return model.transform(frame)


@query("outlier_remove", f"""WITH {_IQR}
SELECT event_id, value, user_id FROM {_EVENTS}, b WHERE NOT ({_OUT} OR user_id < ulo OR user_id > uhi)""")
def outlier_remove(spark, sf):
    frame, model = fitted(spark, sf, handling="remove")
    return model.transform(frame)


@query("outlier_clip", f"""WITH {_IQR}
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value,
       round(CASE WHEN user_id < ulo THEN ulo WHEN user_id > uhi THEN uhi ELSE user_id END, 6) AS user_id
FROM {_EVENTS}, b""")
def outlier_clip(spark, sf):
    frame, model = fitted(spark, sf, handling="clip")
    return rounded(model.transform(frame))


@query("outlier_winsorize", f"""WITH {_IQR}
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value, user_id,
       CASE WHEN {_OUT} THEN value END AS "Original_value_Outlier", {_OUT}::INTEGER AS "Outlier_Flag_value",
       {_OUT}::INTEGER AS "Outlier_Flag_Any" FROM {_EVENTS}, b""")
def outlier_winsorize(spark, sf):
    frame, model = fitted(spark, sf, handling="winsorize", columns=["value"])
    return rounded(model.transform(frame), 6, ["value"])


@query("outlier_report", f"""WITH {_IQR}
SELECT 'value' AS "column", count(*) FILTER (value < lo OR value > hi) AS outliers,
       round(count(*) FILTER (value < lo OR value > hi) * 100.0::DOUBLE / count(value), 2) AS pct_of_values,
       round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound, count(value) AS non_null
FROM {_EVENTS}, b UNION ALL
SELECT 'user_id', count(*) FILTER (user_id < ulo OR user_id > uhi),
       round(count(*) FILTER (user_id < ulo OR user_id > uhi) * 100.0::DOUBLE / count(user_id), 2),
       round(any_value(ulo), 4), round(any_value(uhi), 4), count(user_id) FROM {_EVENTS}, b""")
def outlier_report(spark, sf):
    frame, model = fitted(spark, sf)
    return model.report(frame)


@query("outlier_rows", f"""WITH {_IQR}
SELECT event_id, value, user_id, 1::INTEGER AS outlier_flag,
       array_to_string([CASE WHEN {_OUT} THEN 'value' END, CASE WHEN user_id < ulo OR user_id > uhi
                        THEN 'user_id' END], ',') AS outlier_columns
FROM {_EVENTS}, b WHERE {_OUT} OR user_id < ulo OR user_id > uhi""")
def outlier_rows(spark, sf):
    frame, model = fitted(spark, sf)
    return model.outlier_rows(frame).withColumn("outlier_columns", F.array_join("outlier_columns", ","))


@query("outlier_zscore_pop", """
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d, skewness(c_acctbal) AS g FROM customer),
     b AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)
SELECT c_custkey, (c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)
                   OR (abs(g) < 1 AND abs((c_acctbal - m) / d) > 3))::INTEGER AS c_acctbal
FROM customer, s, b""")
def outlier_zscore_pop(spark, sf):
    return auto_outliers(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"], forest=False).flags


def _hash_sql(text):
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE"


def _path_sql(n):
    return f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n} END"


def _forest_sql(source, trees=100, sample=256, seed=42, depth=8):
    """CTEs that end in ``flags(k, flag)``: the forest over ``source(k, v)``, grown level by level and walked by every row."""
    parts = [
        f"e AS ({source})", f"c AS (SELECT ln(1 - ({sample} + 8 * sqrt({sample}.0::DOUBLE) + 32) / count(*)) AS lp FROM e)",
        f"""g AS (SELECT k, v, j, 1 + floor(ln({_hash_sql(f"k::VARCHAR || '#' || j || '{seed}t'")}) / lp) AS step FROM e, c, range(1, {trees + 1}) r(j))""",
        "a AS (SELECT k, v, sum(step) OVER (PARTITION BY k ORDER BY j) - 1 AS tree FROM g)",
        f"""r0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, v FROM (SELECT k, v, tree::BIGINT AS tree, row_number() OVER (
              PARTITION BY tree ORDER BY md5(k::VARCHAR || '#' || tree::BIGINT || '{seed}s'), k) AS r FROM a WHERE tree < {trees}) WHERE r <= {sample})""",
        f"d0 AS (SELECT k, v, t.tree, 1::BIGINT AS node, NULL::DOUBLE AS path FROM e, range({trees}) t(tree))"]
    for level in range(depth + 1):
        cut = f"""min(v) + {_hash_sql(f"tree || '#' || node || '{seed}c'")} * (max(v) - min(v))"""
        leaf = f"n <= 1 OR lo = hi OR {level} = {depth}"
        parts += [
            f"q{level} AS MATERIALIZED (SELECT tree, node, count(*) AS n, min(v) AS lo, max(v) AS hi, {cut} AS cut FROM r{level} GROUP BY tree, node)",
            f"""d{level + 1} AS MATERIALIZED (SELECT d.k, d.v, d.tree, CASE WHEN d.path IS NULL AND NOT ({leaf}) THEN 2 * d.node + (d.v > q.cut)::INT ELSE d.node END AS node,
                  CASE WHEN d.path IS NOT NULL THEN d.path WHEN {leaf} THEN {level} + {_path_sql('q.n')} END AS path
                FROM d{level} d LEFT JOIN q{level} q ON d.path IS NULL AND q.tree = d.tree AND q.node = d.node)""",
            f"""r{level + 1} AS MATERIALIZED (SELECT r.tree, 2 * r.node + (r.v > q.cut)::INT AS node, r.v FROM r{level} r
                JOIN q{level} q USING (tree, node) WHERE q.n > 1 AND q.lo < q.hi)"""]
    parts += [
        f"p AS (SELECT k, round(2.0 ** (-avg(path) / ({_path_sql(sample)})), 9) AS score FROM d{depth + 1} GROUP BY k)",
        "flags AS (SELECT k, (score > (SELECT quantile_cont(score, 0.95) FROM p))::INTEGER AS flag FROM p)"]
    return ", ".join(parts)


@query("outlier_isoforest", f"""
WITH {_forest_sql(f"SELECT event_id AS k, value AS v FROM {_EVENTS} WHERE value IS NOT NULL")}
SELECT event_id, value, user_id, coalesce(flag, 0) AS "value_Outlier_Flag" FROM {_EVENTS} LEFT JOIN flags ON k = event_id""")
def outlier_isoforest(spark, sf):
    frame = events(spark, sf)
    return IsolationForest("value", "event_id").fit(frame).transform(frame)


@query("outlier_auto", f"""
WITH e AS (SELECT event_id, value, user_id::DOUBLE AS user_id FROM events),
     b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                  quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3,
                  avg(user_id) AS m, stddev_pop(user_id) AS d FROM e)
SELECT event_id, value, user_id FROM e, b
WHERE NOT (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
           OR user_id < u1 - 1.5 * (u3 - u1) OR user_id > u3 + 1.5 * (u3 - u1) OR abs((user_id - m) / d) > 3)""")
def outlier_auto(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    return auto_outliers(frame, "event_id", forest=False).cleaned


# a column with about 8% outliers is clipped and, being right-skewed, taken to log1p
_HEAVY = "CASE WHEN event_id % 14 = 0 THEN 600 + event_id % 100 ELSE user_id END::DOUBLE"


@query("outlier_auto_winsorize", f"""
WITH e AS (SELECT event_id, {_HEAVY} AS v FROM events),
     q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM e)
SELECT event_id, round(ln(1 + CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END), 6) AS v FROM e, q""")
def outlier_auto_winsorize(spark, sf):
    k = F.col("event_id")
    heavy = F.when(k % 14 == 0, 600 + k % 100).otherwise(F.col("user_id")).cast("double")
    frame = table(spark, sf, "events").select("event_id", heavy.alias("v"))
    return rounded(auto_outliers(frame, "event_id", forest=False).cleaned)


@query("outlier_auto_forest", f"""
WITH {_forest_sql("SELECT event_id AS k, value AS v FROM events")},
     b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
     o AS (SELECT count(*) FILTER (flag = 1 OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n, count(*) AS t
           FROM events JOIN flags ON k = event_id, b)
SELECT 'value' AS feature, n AS outliers, round(100.0::DOUBLE * n / t, 2) AS pct_outliers, 'quartiles + forest' AS detection,
       CASE WHEN 100.0 * n / t < 5 THEN 'rows removed' WHEN 100.0 * n / t <= 15 THEN 'clipped, log1p' ELSE 'scaled by quartiles' END AS handling
FROM o""")
def outlier_auto_forest(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value")
    return auto_outliers(frame, "event_id").report
