"""Distribution transforms."""

from pyspark.sql import functions as F

from tabprep.functions import math as M
from tabprep.operators import distribution as D
from tabprep.plans.auto import AutoTransform
from tabprep.queries.registry import query, rounded, table

_LINES = "(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)"


def lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def _applied(spark, sf, method, columns=("l_quantity", "l_extendedprice"), **settings):
    frame = lines(spark, sf)
    return rounded(D.DistributionTransformer(method, list(columns), **settings).fit(frame).transform(frame))


def _sql(formula):
    return f"""SELECT l_orderkey, l_linenumber, round({formula.format(c='l_quantity')}, 6) AS l_quantity,
       round({formula.format(c='l_extendedprice')}, 6) AS l_extendedprice FROM {_LINES}"""


@query("tx_log", _sql("ln({c} + 1.0)"))
def tx_log(spark, sf):
    return _applied(spark, sf, "log")


@query("tx_log_ignore", """SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS c_acctbal
                           FROM customer""")
def tx_log_ignore(spark, sf):
    frame = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(D.DistributionTransformer("log", ["c_acctbal"], "ignore").fit(frame).transform(frame))


@query("tx_log1p_select", """
WITH s AS (SELECT avg(value) > median(value) AND min(value) >= 0 AND stddev_samp(value) > 1 AS chosen FROM events)
SELECT event_id, ts, round(ln(value + 1), 6) AS value_log, 1.0::DOUBLE AS one FROM events, s WHERE chosen""")
def tx_log1p_select(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "ts", "value", F.lit(1.0).alias("one"))
    return rounded(D.LogSelector(exclude=["event_id"]).fit(frame).transform(frame), 6, ["value_log"])


@query("tx_sqrt", _sql("sqrt({c})"))
def tx_sqrt(spark, sf):
    return _applied(spark, sf, "sqrt")


@query("tx_cbrt", """SELECT c_custkey, round(cbrt(c_acctbal), 6) AS c_acctbal FROM customer""")
def tx_cbrt(spark, sf):
    frame = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(D.DistributionTransformer("cube-root", ["c_acctbal"]).fit(frame).transform(frame))


@query("tx_inverse", _sql("1.0 / ({c} + 1.0)"))
def tx_inverse(spark, sf):
    return _applied(spark, sf, "inverse")


@query("tx_power", """SELECT l_orderkey, l_linenumber, round(l_quantity ** 3, 6) AS l_quantity, l_extendedprice
                      FROM lineitem""")
def tx_power(spark, sf):
    return _applied(spark, sf, "power", ["l_quantity"], power_value=3.0)


@query("tx_add_constant", _sql("{c} + 2.5"))
def tx_add_constant(spark, sf):
    return _applied(spark, sf, "constant-addition", offset=2.5)


@query("tx_winsorize", """
WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events),
     b AS (SELECT max(value) FILTER (k = floor(0.01 * n)) AS lo,
                  max(value) FILTER (k = n - floor(0.01 * n) - 1) AS hi FROM r)
SELECT event_id, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value FROM events, b""")
def tx_winsorize(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value")
    return D.DistributionTransformer("winsorizing", ["value"]).fit(frame).transform(frame)


@query("tx_clip_quantile", """
WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM events, b""")
def tx_clip_quantile(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value")
    return rounded(D.DistributionTransformer("clipping", ["value"]).fit(frame).transform(frame))


@query("tx_bin_quartile", """
WITH b AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2,
                  quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_extendedprice, 0.25) AS p1,
                  quantile_cont(l_extendedprice, 0.5) AS p2, quantile_cont(l_extendedprice, 0.75) AS p3 FROM lineitem)
SELECT l_orderkey, l_linenumber,
       ((l_quantity > q1)::INT + (l_quantity > q2)::INT + (l_quantity > q3)::INT)::DOUBLE AS l_quantity,
       ((l_extendedprice > p1)::INT + (l_extendedprice > p2)::INT + (l_extendedprice > p3)::INT)::DOUBLE AS l_extendedprice
FROM lineitem, b""")
def tx_bin_quartile(spark, sf):
    return _applied(spark, sf, "data-binning")


def _horner_sql(coefficients, x):
    out = repr(coefficients[0])
    for a in coefficients[1:]:
        out = f"({out} * {x} + {a!r}::DOUBLE)"
    return out


def _normal_quantile_sql(p):
    """The rational approximation of the inverse normal distribution function that the operator uses."""
    near, centre = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    tail = f"{_horner_sql(M._C, near)} / {_horner_sql(M._D, near)}"
    square = f"({centre} * {centre})"
    body = f"{centre} * {_horner_sql(M._A, square)} / {_horner_sql(M._B, square)}"
    return f"CASE WHEN {p} < {M._TAIL} THEN {tail} WHEN {p} > 1 - {M._TAIL} THEN -({tail}) ELSE {body} END"


@query("tx_quantile_normal", f"""
WITH l AS (SELECT unnest(quantile_cont(value, [{", ".join(repr(i / 999) for i in range(1000))}])) AS v, unnest(range(1000)) / 999.0::DOUBLE AS p FROM events),
     d AS (SELECT v, min(p) AS lo, max(p) AS hi FROM l GROUP BY v),
     m AS (SELECT v, lo, hi, lead(v) OVER (ORDER BY v) AS v1, lead(lo) OVER (ORDER BY v) AS p1 FROM d),
     a AS (SELECT event_id, CASE WHEN v1 IS NULL THEN 1.0 WHEN value <= (SELECT min(v) FROM d) THEN 0.0 WHEN value = v THEN (lo + hi) / 2
                                 ELSE hi + (value - v) / (v1 - v) * (p1 - hi) END AS p
           FROM events ASOF JOIN m ON events.value >= m.v),
     e AS (SELECT event_id, least(greatest(p, {D.EDGE}), 1 - {D.EDGE}) AS p FROM a)
SELECT event_id, round({_normal_quantile_sql('p')}, 6) AS value FROM e""")
def tx_quantile_normal(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value")
    return rounded(D.DistributionTransformer("quantile", ["value"]).fit(frame).transform(frame))


@query("tx_zscore", """
WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS d, avg(l_extendedprice) AS pm,
                  stddev_samp(l_extendedprice) AS pd FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 6) AS l_quantity,
       round((l_extendedprice - pm) / pd, 6) AS l_extendedprice FROM lineitem, s""")
def tx_zscore(spark, sf):
    return _applied(spark, sf, "z-score")


def _lambda_sql(kind, source):
    """CTEs that end in ``lam(lam)``: the exponent with the highest likelihood of ``source(t)``, on ever finer grids."""
    up = "(exp(lam * t) - 1) / lam"
    if kind == "box_cox":
        moved = f"CASE WHEN lam = 0 THEN t ELSE {up} END"
    else:
        moved = f"""CASE WHEN t >= 0 AND lam = 0 THEN t WHEN t >= 0 THEN {up} WHEN lam = 2 THEN t
                    ELSE -(exp((2 - lam) * -t) - 1) / (2 - lam) END"""
    best = f"GROUP BY lam ORDER BY (lam - 1) * avg(t) - ln(var_pop({moved})) / 2 DESC LIMIT 1"
    levels = [f"x AS ({source})", f"l0 AS (SELECT lam FROM (SELECT i / 4.0::DOUBLE AS lam FROM range(-16, 17) r(i)), x {best})"]
    for k in range(1, 7):
        levels.append(f"l{k} AS (SELECT lam FROM (SELECT lam + i * {0.25 / 10 ** k}::DOUBLE AS lam FROM l{k - 1}, range(-10, 11) r(i)), x {best})")
    return ", ".join(levels) + ", lam AS (SELECT lam FROM l6)"


@query("tx_boxcox", f"""
WITH {_lambda_sql('box_cox', 'SELECT ln(value + 1) AS t FROM events')}, r AS (SELECT round(lam, 4) AS lam FROM lam)
SELECT event_id, round(((value + 1) ** lam - 1) / lam, 6) AS value FROM events, r""")
def tx_boxcox(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value")
    model = D.DistributionTransformer("box-cox", ["value"]).fit(frame)
    return rounded(_with_short_lambdas(model, model.params).transform(frame))


def _with_short_lambdas(model, params):
    """The exponents with four digits, so that two searches end in the same one."""
    for p in params.values():
        p["lambda"] = round(p["lambda"], 4)
    return model


@query("tx_boxcox_fixed", """SELECT event_id, round(((value + 1) ** 0.25 - 1) / 0.25, 6) AS value FROM events""")
def tx_boxcox_fixed(spark, sf):
    model = D.FittedDistribution("box_cox", {"value": {"lambda": 0.25}})
    return rounded(model.transform(table(spark, sf, "events").select("event_id", "value")))


@query("tx_yeojohnson", f"""
WITH {_lambda_sql('yeo_johnson', 'SELECT sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS t FROM customer')},
     r AS (SELECT round(lam, 4) AS lam FROM lam)
SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN ((c_acctbal + 1) ** lam - 1) / lam
                             ELSE -((1 - c_acctbal) ** (2 - lam) - 1) / (2 - lam) END, 6) AS c_acctbal FROM customer, r""")
def tx_yeojohnson(spark, sf):
    frame = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    model = D.DistributionTransformer("yeo-johnson", ["c_acctbal"]).fit(frame)
    return rounded(_with_short_lambdas(model, model.params).transform(frame))


@query("tx_yeojohnson_fixed", """
SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN ((c_acctbal + 1) ** 0.5 - 1) / 0.5
                             ELSE -((1 - c_acctbal) ** 1.5 - 1) / 1.5 END, 6) AS c_acctbal FROM customer""")
def tx_yeojohnson_fixed(spark, sf):
    model = D.FittedDistribution("yeo_johnson", {"c_acctbal": {"lambda": 0.5}})
    return rounded(model.transform(table(spark, sf, "customer").select("c_custkey", "c_acctbal")))


_FIXED = {"log": "exp(x) - 1", "box_cox": "(x * 0.25 + 1) ** 4 - 1",
          "yeo_johnson": "CASE WHEN x >= 0 THEN (x * 0.5 + 1) ** 2 - 1 ELSE 1 - (1 - x * 1.5) ** (1 / 1.5) END"}


@query("inverse_fixed", f"""
WITH c AS (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)
SELECT c_custkey, round({_FIXED['log']}, 6) AS log, round(CASE WHEN x > -4 THEN {_FIXED['box_cox']} END, 6) AS box_cox,
       round({_FIXED['yeo_johnson']}, 6) AS yeo_johnson FROM c""")
def inverse_fixed(spark, sf):
    """Inverses of given parameters on numbers that no transform made."""
    x = F.col("c_acctbal") / 1000
    frame = table(spark, sf, "customer").select("c_custkey", x.alias("log"), x.alias("box_cox"), x.alias("yeo_johnson"))
    for method, lam in (("log", None), ("box_cox", 0.25), ("yeo_johnson", 0.5)):
        frame = D.FittedDistribution(method, {method: {"lambda": lam}}).inverse_transform(frame)
    return rounded(frame)


@query("inverse_log", """SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
                                round(l_extendedprice, 6) AS l_extendedprice FROM lineitem""")
def inverse_log(spark, sf):
    frame = lines(spark, sf)
    model = D.DistributionTransformer("log", ["l_quantity", "l_extendedprice"]).fit(frame)
    return rounded(model.inverse_transform(model.transform(frame)))


@query("inverse_boxcox", "SELECT event_id, round(value, 6) AS value FROM events")
def inverse_boxcox(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value")
    model = D.DistributionTransformer("box_cox", ["value"]).fit(frame)
    return rounded(model.inverse_transform(model.transform(frame)))


@query("inverse_yeojohnson", "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer")
def inverse_yeojohnson(spark, sf):
    frame = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    model = D.DistributionTransformer("yeo_johnson", ["c_acctbal"]).fit(frame)
    return rounded(model.inverse_transform(model.transform(frame)))


_SKEW = """(SELECT 'value' AS "column", skewness(value) AS s FROM events UNION ALL
            SELECT 'user_id', skewness(user_id) FROM events UNION ALL
            SELECT 'rest', skewness(event_id % 100 % 13) FROM events)"""


def _skewed(spark, sf):
    return table(spark, sf, "events").select("value", "user_id", (F.col("event_id") % 100 % 13).alias("rest"))


@query("skewness_report", f"""SELECT "column", round(s, 6) AS skewness, 0::INTEGER AS transformed,
                                     NULL::DOUBLE AS lambda FROM {_SKEW}""")
def skewness_report(spark, sf):
    return rounded(D.skewness_report(_skewed(spark, sf)))


@query("skewness_advice", f"""
SELECT "column", round(s, 6) AS skewness,
       CASE WHEN abs(s) > 1 THEN 'highly skewed' WHEN abs(s) > 0.5 THEN 'moderately skewed'
            ELSE 'approximately symmetric' END AS band,
       CASE WHEN abs(s) > 1 THEN 'log, Box-Cox or Yeo-Johnson' WHEN abs(s) > 0.5 THEN 'square root or log'
            ELSE 'none needed' END AS suggestion FROM {_SKEW}""")
def skewness_advice(spark, sf):
    return rounded(D.skewness_advice(_skewed(spark, sf)))


@query("skew_improvement", """
SELECT 'value' AS "column", round(skewness(value), 6) AS skew_before, round(skewness(ln(value + 1)), 6) AS skew_after,
       round((abs(skewness(value)) - abs(skewness(ln(value + 1)))) / abs(skewness(value)) * 100.0, 6) AS improvement_pct
FROM events""")
def skew_improvement(spark, sf):
    frame = table(spark, sf, "events").select("value")
    after = D.DistributionTransformer("log").fit(frame).transform(frame)
    return rounded(D.skew_improvement(frame, after, ["value"]))


@query("tx_auto", f"""
WITH {_lambda_sql('box_cox', 'SELECT ln(n_chars) AS t FROM documents')}, r AS (SELECT round(lam, 4) AS lam FROM lam)
SELECT doc_id, round((n_chars ** lam - 1) / lam, 6) AS n_chars FROM documents, r""")
def tx_auto(spark, sf):
    frame = table(spark, sf, "documents").select("doc_id", "n_chars")
    model = AutoTransform(["n_chars"]).fit(frame)
    return rounded(_with_short_lambdas(model, model.methods).transform(frame))


def _population_skewness(x, source):
    return f"(SELECT avg(({x} - m) ** 3) / max(d) ** 3 FROM {source}, (SELECT avg({x}) AS m, stddev_pop({x}) AS d FROM {source}))"


@query("tx_auto_report", f"""
WITH {_lambda_sql('box_cox', 'SELECT ln(value) AS t FROM events')},
     y AS (SELECT (value ** lam - 1) / lam AS y FROM events, lam)
SELECT 'user_id' AS feature, round({_population_skewness('user_id', 'events')}, 3) AS skew_before, 0::INTEGER AS transformed, 'none' AS method,
       round({_population_skewness('user_id', 'events')}, 3) AS skew_after
UNION ALL SELECT 'value', round({_population_skewness('value', 'events')}, 3), 1, 'box_cox',
       round({_population_skewness('y', 'y')}, 3)""")
def tx_auto_report(spark, sf):
    frame = table(spark, sf, "events").select("user_id", "value")
    return AutoTransform().fit(frame).report(frame)
