"""Feature creation, extraction and selection; chains of such steps."""

from pyspark.sql import functions as F

from tabprep.functions.columns import add_all
from tabprep.operators import features as FE
from tabprep.plans.auto import features_auto as auto_features
from tabprep.plans.chain import StepChain
from tabprep.queries.registry import null_when, query, rounded, table

_LINES = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q,
                    CASE WHEN l_linenumber <> 3 THEN l_discount END AS d, CASE WHEN l_linenumber <> 3 OR l_orderkey % 2 = 0
                    THEN l_tax END AS t FROM lineitem)"""


def lines(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", null_when(n == 3, "l_quantity").alias("q"),
        null_when(n == 3, "l_discount").alias("d"),
        F.when((n != 3) | (F.col("l_orderkey") % 2 == 0), F.col("l_tax")).alias("t"))


@query("row_features", f"""
SELECT l_orderkey, l_linenumber, q, d, t,
       round(coalesce(q, 0) + coalesce(d, 0) + coalesce(t, 0), 6) AS sum_features,
       round((coalesce(q, 0) + coalesce(d, 0) + coalesce(t, 0))
             / nullif((q IS NOT NULL)::INT + (d IS NOT NULL)::INT + (t IS NOT NULL)::INT, 0), 6) AS mean_features,
       round(coalesce(q, 1) * coalesce(d, 1) * coalesce(t, 1), 6) AS product_features,
       round(ln(1 + coalesce(q, 0) + coalesce(d, 0) + coalesce(t, 0)), 6) AS log_sum,
       greatest(q, d, t) AS max_feature, least(q, d, t) AS min_feature FROM {_LINES}""")
def row_features(spark, sf):
    frame = lines(spark, sf)
    out = FE.FeatureCreator(columns=["q", "d", "t"]).fit(frame).transform(frame)
    return rounded(out, 6, ["sum_features", "mean_features", "product_features", "log_sum"])


@query("row_sum", f"""SELECT l_orderkey, l_linenumber, q, d, t,
    round(coalesce(q, 0) + coalesce(d, 0) + coalesce(t, 0), 6) AS synthetic_sum FROM {_LINES}""")
def row_sum(spark, sf):
    return rounded(FE.synthetic_sum(lines(spark, sf), ["q", "d", "t"]), 6, ["synthetic_sum"])


@query("custom_rules", """SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount,
    round(sqrt(l_extendedprice ** 2 + l_discount ** 2), 6) AS norm,
    round(l_extendedprice - l_discount, 6) AS difference FROM lineitem""")
def custom_rules(spark, sf):
    frame = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    creator = FE.FeatureCreator({}, ["l_extendedprice", "l_discount"])
    creator.add_rule("norm", lambda xs: F.sqrt(add_all([x * x for x in xs])))
    creator.add_rule("difference", lambda xs: xs[0] - xs[1])
    return rounded(creator.fit(frame).transform(frame), 6, ["norm", "difference"])


# principal axes of two columns in closed form; the largest loading is positive
_PCA = """
WITH s AS (SELECT avg(value) AS mx, avg(user_id) AS my, var_samp(value) AS a, covar_samp(value, user_id) AS b,
                  var_samp(user_id) AS c FROM {source}),
     l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM s),
     v AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS ux, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS uy FROM l),
     w AS (SELECT *, CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) >= 0 THEN 1 ELSE -1 END AS s1,
                  CASE WHEN (CASE WHEN abs(uy) >= abs(ux) THEN -uy ELSE ux END) >= 0 THEN 1 ELSE -1 END AS s2 FROM v)
"""


@query("pca", _PCA.format(source="events") + """
SELECT round(s1 * ((value - mx) * ux + (user_id - my) * uy), 6) AS "PC_1",
       round(s2 * ((value - mx) * -uy + (user_id - my) * ux), 6) AS "PC_2", event_type FROM events, w""")
def pca(spark, sf):
    frame = table(spark, sf, "events").select("value", "user_id", "event_type")
    return rounded(FE.PrincipalComponents().fit(frame).transform(frame))


@query("pca_explained", _PCA.format(source="events") + """
SELECT 'PC_1' AS component, round(l1 / (l1 + l2), 9) AS explained_ratio FROM w""")
def pca_explained(spark, sf):
    frame = table(spark, sf, "events").select("value", "user_id", "event_type")
    return rounded(FE.PrincipalComponents(0.5).fit(frame).explained_variance(frame), 9)


_E = "(SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value, user_id::DOUBLE AS user_id FROM events)"


@query("pca_append", _PCA.format(source=f"(SELECT * FROM {_E} WHERE value IS NOT NULL)") + f"""
SELECT event_id, value, user_id,
       round(s1 * ((coalesce(value, 0) - mx) * ux + (user_id - my) * uy), 6) AS "PC1",
       round(s2 * ((coalesce(value, 0) - mx) * -uy + (user_id - my) * ux), 6) AS "PC2" FROM {_E}, w""")
def pca_append(spark, sf):
    frame = table(spark, sf, "events").select(
        "event_id", null_when(F.col("event_id") % 10 == 0, "value").alias("value"),
        F.col("user_id").cast("double").alias("user_id"))
    model = FE.PrincipalComponents(2, ["value", "user_id"], append=True).fit(frame)
    return rounded(model.transform(frame), 6, ["PC1", "PC2"])


@query("pca_wide")
def pca_wide(spark, sf):
    """All components of the embeddings, built from array blocks."""
    frame = table(spark, sf, "embeddings")
    width = len(frame.first()["embedding"])
    wide = frame.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])
    model = FE.PrincipalComponents(0.9, [f"e{i}" for i in range(width)]).fit(wide)
    return rounded(model.explained_variance(wide))


@query("select_variance", """SELECT l_quantity, l_extendedprice, l_shipmode FROM (
    SELECT l_quantity, l_extendedprice, l_returnflag AS l_shipmode FROM lineitem)
    WHERE (SELECT var_pop(l_quantity) > 1 AND var_pop(l_discount) <= 1 AND var_pop(l_tax) <= 1 FROM lineitem)""")
def select_variance(spark, sf):
    frame = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                                F.col("l_returnflag").alias("l_shipmode"))
    return FE.FeatureSelector("variance", 1.0).fit(frame).transform(frame)


def _anova(c, t, y):
    return f"""SELECT '{c}' AS feature, round((b / (k - 1)) / (w / (n - k)), 6) AS score FROM (
  SELECT sum(m * (a - g) ** 2) AS b, sum(m * v) AS w, count(*) AS k, sum(m) AS n FROM (
    SELECT count({c}) AS m, avg({c}) AS a, var_pop({c}) AS v FROM {t} GROUP BY {y}), (SELECT avg({c}) AS g FROM {t}))"""


@query("select_univariate", f"""
WITH f AS ({_anova('value', 'events', 'event_type')} UNION ALL {_anova('user_id', 'events', 'event_type')}
           UNION ALL {_anova('event_id', 'events', 'event_type')})
SELECT feature, score, (row_number() OVER (ORDER BY score DESC) <= 2)::INTEGER AS selected FROM f""")
def select_univariate(spark, sf):
    frame = table(spark, sf, "events").select("value", "user_id", "event_id", "event_type")
    return rounded(FE.FeatureSelector("univariate", k=2).fit(frame, "event_type").report(frame))


def _mi(c, edges):
    cut = " + ".join(f"(c > (SELECT quantile_cont(c, {i / 10}) FROM s))::INT" for i in range(1, 10))
    return f"""SELECT '{edges}' AS feature, round(sum(n / t * ln(n * t / (nb * ny))), 6) AS score FROM (
  SELECT n::DOUBLE AS n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM (
    WITH s AS (SELECT {c} AS c, event_type AS y FROM events) SELECT {cut} AS b, y, count(*) AS n FROM s GROUP BY 1, 2))"""


@query("select_mutual_info_binned", f"""SELECT feature, score, 1::INTEGER AS selected FROM (
    {_mi('value', 'value')} UNION ALL {_mi('user_id', 'user_id')})""")
def select_mutual_info_binned(spark, sf):
    frame = table(spark, sf, "events").select("value", "user_id", "event_type")
    selector = FE.FeatureSelector("univariate", score_func=FE.binned_mutual_information)
    return rounded(selector.fit(frame, "event_type").report(frame))


def _psi(n):
    """The digamma function of a whole number, raised by 8 before its series."""
    raised = f"({n} + 8.0::DOUBLE)"
    low = " - ".join(f"1.0 / ({n} + {i}.0::DOUBLE)" for i in range(8))
    return (f"(ln{raised} - 1 / (2 * {raised}) - 1 / (12 * {raised} ** 2) + 1 / (120 * {raised} ** 4) - 1 / (252 * {raised} ** 6)"
            f" + 1 / (240 * {raised} ** 8) - {low})")


def _neighbour_mi(c):
    """Every pair inside a class, and every pair of the column."""
    return f"""
SELECT '{c}' AS feature, greatest(0, {_psi('max(n)')} + avg({_psi('least(3, size - 1)')}) - avg({_psi('size')}) - avg({_psi('m')})) AS score
FROM (SELECT p.id, p.size, p.n, (SELECT count(*) FROM e WHERE abs(e.{c} - p.x) <= p.r * (1 - 1e-9)) AS m FROM (
  SELECT a.event_id AS id, a.{c} AS x, count(*) AS size, (SELECT count(*) FROM e) AS n,
         list_sort(list(abs(a.{c} - b.{c})))[least(4, count(*))] AS r
  FROM e a JOIN e b ON a.event_type = b.event_type GROUP BY a.event_id, a.{c}) p)"""


@query("select_mutual_info", f"""
WITH e AS (SELECT event_id, event_type, value, user_id::DOUBLE AS user_id FROM events)
SELECT feature, round(score, 6) AS score, 1::INTEGER AS selected FROM ({_neighbour_mi('value')} UNION ALL {_neighbour_mi('user_id')})""")
def select_mutual_info(spark, sf):
    frame = table(spark, sf, "events").select("value", "user_id", "event_type")
    selector = FE.FeatureSelector("univariate", score_func=FE.mutual_information)
    return rounded(selector.fit(frame, "event_type").report(frame))


@query("select_mutual_info_continuous", f"""
WITH q AS (SELECT c_custkey AS id, c_acctbal AS x, (c_acctbal * c_acctbal / 1000 + c_custkey % 97 * 30)::DOUBLE AS y FROM customer),
     e AS (SELECT id, x / (SELECT stddev_pop(x) FROM q) AS x, y / (SELECT stddev_pop(y) FROM q) AS y FROM q),
     r AS (SELECT a.id, a.x, a.y, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[4] * (1 - 1e-9) AS s
           FROM e a, e b GROUP BY a.id, a.x, a.y),
     m AS (SELECT r.id, count(*) FILTER (abs(e.x - r.x) <= s) AS a, count(*) FILTER (abs(e.y - r.y) <= s) AS b
           FROM r, e GROUP BY r.id)
SELECT 'x' AS feature, round(greatest(0, (SELECT {_psi('count(*)')} FROM e) + {_psi('3')} - avg({_psi('a')}) - avg({_psi('b')})), 6) AS score,
       1::INTEGER AS selected FROM m""")
def select_mutual_info_continuous(spark, sf):
    x = F.col("c_acctbal")
    frame = table(spark, sf, "customer").select(
        x.alias("x"), (x * x / 1000 + F.col("c_custkey") % 97 * 30).cast("double").alias("y"))
    return rounded(FE.FeatureSelector("univariate", score_func=FE.mutual_information).fit(frame, "y").report(frame))


@query("select_correlation", """
WITH r AS (SELECT 'l_quantity' AS feature, abs(corr(l_quantity, 3 * l_quantity + 100 * l_discount)) AS c FROM lineitem
           UNION ALL SELECT 'l_discount', abs(corr(l_discount, 3 * l_quantity + 100 * l_discount)) FROM lineitem
           UNION ALL SELECT 'l_tax', abs(corr(l_tax, 3 * l_quantity + 100 * l_discount)) FROM lineitem)
SELECT feature, round(c, 6) AS score, (c > 0.02)::INTEGER AS selected FROM r""")
def select_correlation(spark, sf):
    frame = table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") * 3 + F.col("l_discount") * 100).alias("y"))
    return rounded(FE.FeatureSelector("correlation", 0.02).fit(frame, "y").report(frame))


@query("select_project", """
SELECT value + CASE WHEN event_type = 'error' THEN 1e4 ELSE 0.0 END AS mixed, event_type, ts FROM events""")
def select_project(spark, sf):
    """The better of two columns by a fitted selection; columns that are no numbers stay after it."""
    frame = table(spark, sf, "events").select(
        "user_id", "event_type", (F.col("value") + F.when(F.col("event_type") == "error", 1e4).otherwise(0.0)).alias("mixed"), "ts")
    return FE.FeatureSelector("univariate", k=1).fit(frame, "event_type").transform(frame)


@query("polynomial_features", """
SELECT l_orderkey, l_quantity, l_discount, l_quantity * l_quantity AS "l_quantity^2",
       l_quantity * l_discount AS "l_quantity l_discount", l_discount * l_discount AS "l_discount^2" FROM lineitem""")
def polynomial_features(spark, sf):
    frame = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    return FE.polynomial_features(frame, ["l_quantity", "l_discount"])


@query("date_parts", """SELECT o_orderkey, o_orderdate, day(o_orderdate)::INTEGER AS o_orderdate_day,
    month(o_orderdate)::INTEGER AS o_orderdate_month, (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_weekday FROM orders""")
def date_parts(spark, sf):
    return FE.date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@query("equal_width_bins", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, value, user_id, (value > lo + (hi - lo) / 4)::INT + (value > lo + 2 * (hi - lo) / 4)::INT
       + (value > lo + 3 * (hi - lo) / 4)::INT AS value_bin,
       CASE WHEN user_id > 0 AND user_id <= 10 THEN 0 WHEN user_id > 10 AND user_id <= 50 THEN 1
            WHEN user_id > 50 AND user_id <= 100 THEN 2 END::INTEGER AS user_id_bin FROM events, b""")
def equal_width_bins(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value", "user_id")
    return FE.EqualWidthBinner({"value": 4, "user_id": [0, 10, 50, 100]}).fit(frame).transform(frame)


@query("features_auto", """
WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT l_quantity, l_shipdate, l_quantity * l_quantity AS "l_quantity^2", day(l_shipdate)::INTEGER AS l_shipdate_day,
       month(l_shipdate)::INTEGER AS l_shipdate_month, (isodow(l_shipdate) - 1)::INTEGER AS l_shipdate_weekday,
       (l_quantity > lo + (hi - lo) / 3)::INT + (l_quantity > lo + 2 * (hi - lo) / 3)::INT AS l_quantity_bin
FROM lineitem, b""")
def features_auto(spark, sf):
    frame = table(spark, sf, "lineitem").select("l_quantity", "l_shipdate")
    return auto_features(frame, 2, ["l_shipdate"], {"l_quantity": 3})[0]


@query("feature_steps", """
SELECT l_quantity, round(l_quantity + l_discount + l_tax, 6) AS sum_features, l_returnflag FROM lineitem""")
def feature_steps(spark, sf):
    """A created column, then a selection by variance that leaves out discount and tax."""
    frame = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    creator = FE.FeatureCreator({"sum_features": FE.row_sum})
    chain = StepChain([("create", creator), ("select", FE.FeatureSelector("variance", 1.0))])
    return rounded(chain.fit(frame).transform(frame), 6, ["sum_features"])
