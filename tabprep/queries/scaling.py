"""Scaling."""

from pyspark.sql import functions as F

from tabprep.functions.math import normality_p
from tabprep.functions.moments import profile
from tabprep.operators.scaling import FeatureScaler
from tabprep.plans.auto import AutoScaler
from tabprep.queries.registry import query, rounded, table

COLUMNS = ["l_quantity", "l_extendedprice"]


def lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *COLUMNS)


def _scaled(spark, sf, method, **settings):
    frame = lines(spark, sf)
    return rounded(FeatureScaler(method, COLUMNS, **settings).fit(frame).transform(frame))


def _sql(center, scale, suffix="_scaled", keep=True):
    parts = ", ".join(f"""round((l.{c} - {center.format(c=c)}) / {scale.format(c=c)}, 6) AS {c}{suffix}"""
                      for c in COLUMNS)
    kept = "l_quantity, l_extendedprice, " if keep else ""
    stats = ", ".join(f"""avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_d, min({c}) AS {c}_lo, max({c}) AS {c}_hi,
        median({c}) AS {c}_q2, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr""" for c in COLUMNS)
    return f"""WITH s AS (SELECT {stats} FROM lineitem)
               SELECT l_orderkey, l_linenumber, {kept} {parts} FROM lineitem l, s"""


@query("scale_standard", _sql("{c}_m", "{c}_d"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_minmax", _sql("{c}_lo", "({c}_hi - {c}_lo)"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("scale_robust", _sql("{c}_q2", "{c}_iqr"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query("scale_inverse", """SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity_original,
                                  round(l_extendedprice, 6) AS l_extendedprice_original FROM lineitem""")
def scale_inverse(spark, sf):
    frame = lines(spark, sf)
    model = FeatureScaler("robust", COLUMNS).fit(frame)
    back = model.inverse_transform(model.transform(frame))
    return rounded(back.select("l_orderkey", "l_linenumber", "l_quantity_original", "l_extendedprice_original"))


@query("scale_inplace", """
WITH s AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS d FROM supplier)
SELECT s_suppkey, round((s_acctbal - m) / d, 6) AS s_acctbal, 1.0::DOUBLE AS one FROM supplier, s""")
def scale_inplace(spark, sf):
    frame = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.lit(1.0).alias("one"))
    scaler = FeatureScaler("standard", ["s_acctbal", "one"], in_place=True, min_std=1e-9)
    return rounded(scaler.fit(frame).transform(frame))


# the K-squared test from moments, written out
_P = """
WITH m AS (SELECT count({c})::DOUBLE AS n, avg({c}) AS a FROM {t}),
     k AS (SELECT n, avg(({c} - a) ** 3) / avg(({c} - a) ** 2) ** 1.5 AS g1,
                  avg(({c} - a) ** 4) / avg(({c} - a) ** 2) ** 2 AS b2 FROM {t}, m GROUP BY n),
     p AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
                  3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
                  3 * (n - 1) / (n + 1) AS e,
                  24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)) AS v,
                  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
                    * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM k),
     q AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, (b2 - e) / sqrt(v) AS x,
                  6 + 8 / s * (2 / s + sqrt(1 + 4 / s ** 2)) AS aa FROM p),
     z AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
                  (1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM q)
SELECT '{c}' AS "column", round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p, (exp(-(z1 * z1 + z2 * z2) / 2) > 0.05)::INTEGER AS normal FROM z"""


@query("normality_test", "SELECT * FROM (" + _P.format(c="s_acctbal", t="supplier") + ") UNION ALL SELECT * FROM ("
       + _P.format(c="value", t="events") + ") UNION ALL SELECT * FROM (" + _P.format(
           c="three", t="(SELECT (hash_a + hash_b + hash_c)::DOUBLE AS three FROM (SELECT event_id % 7 AS hash_a, "
                        "event_id // 7 % 7 AS hash_b, event_id // 49 % 7 AS hash_c FROM events))") + ")")
def normality_test(spark, sf):
    k = F.col("event_id")
    three = (k % 7 + F.floor(k / 7) % 7 + F.floor(k / 49) % 7).cast("double").alias("three")
    frames = [(table(spark, sf, "supplier"), "s_acctbal"), (table(spark, sf, "events"), "value"),
              (table(spark, sf, "events").select(three), "three")]
    rows = []
    for frame, c in frames:
        m = profile(frame, [c], ["n", "skew_pop", "kurt_pop"])[c]
        p = normality_p(m["n"], m["skew_pop"], m["kurt_pop"])
        rows.append((c, None if p is None else round(p, 6) + 0.0, int(p is not None and p > 0.05)))
    return spark.createDataFrame(rows, "column string, p double, normal int")


_AUTO = """
WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3,
                  min(user_id) AS lo, max(user_id) AS hi FROM events),
     f AS (SELECT avg((value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::INT) AS share FROM events, s)
"""


@query("scale_auto", _AUTO + """
SELECT event_id, round(CASE WHEN share > 0.05 THEN (value - q2) / (q3 - q1)
                            ELSE (value - mn) / (mx - mn) END, 6) AS value,
       round((user_id - lo) / (hi - lo), 6) AS user_id
FROM events, s, f, (SELECT min(value) AS mn, max(value) AS mx FROM events)""")
def scale_auto(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value", "user_id")
    return rounded(AutoScaler(columns=["value", "user_id"]).fit(frame).transform(frame))


@query("scale_auto_report", _AUTO + """
SELECT 'value' AS feature, 'skewed' AS distribution, round(sk.g, 3) AS skewness, round(share, 3) AS outlier_fraction,
       CASE WHEN share > 0.05 THEN 'robust' ELSE 'minmax' END AS scaler
FROM f, (SELECT avg((value - a) ** 3) / avg((value - a) ** 2) ** 1.5 AS g
         FROM events, (SELECT avg(value) AS a FROM events)) sk""")
def scale_auto_report(spark, sf):
    frame = table(spark, sf, "events").select("value")
    return AutoScaler().fit(frame).report(frame)
