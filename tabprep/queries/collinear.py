"""Collinearity."""

from pyspark.sql import functions as F

from tabprep.operators import collinear as C
from tabprep.plans.auto import collinear_auto as auto_collinear
from tabprep.queries.registry import null_when, query, rounded, table

NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, sf, *more):
    return table(spark, sf, "lineitem").select(*NAMES, *more)


# the inverse of a Gram matrix of three columns, by cofactors
_THREE = """
WITH g AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(x * z) AS c, sum(y * y) AS d, sum(y * z) AS e, sum(z * z) AS f
           FROM ({source})),
     k AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM g)
"""


@query("vif", _THREE.format(source="SELECT l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem") + """
SELECT 'x' AS feature, round(a * (d * f - e * e) / det, 6) AS vif FROM k
UNION ALL SELECT 'y', round(d * (a * f - c * c) / det, 6) FROM k
UNION ALL SELECT 'z', round(f * (a * d - b * b) / det, 6) FROM k""")
def vif(spark, sf):
    frame = lines(spark, sf).select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"),
                                    (F.col("l_tax") * 100).alias("z"))
    return rounded(C.vif_table(frame, ["x", "y", "z"]))


@query("vif_two", """
SELECT 'l_quantity' AS feature, round(1 / (1 - sum(l_quantity * l_tax) ** 2
       / (sum(l_quantity ** 2) * sum(l_tax ** 2))), 6) AS vif FROM lineitem
UNION ALL SELECT 'l_tax', round(1 / (1 - sum(l_quantity * l_tax) ** 2
       / (sum(l_quantity ** 2) * sum(l_tax ** 2))), 6) FROM lineitem""")
def vif_two(spark, sf):
    return rounded(C.vif_table(lines(spark, sf), ["l_quantity", "l_tax"]))


# each of the three is determined by the others; the first goes, then two remain within the limit
@query("vif_eliminate", """
WITH v AS (SELECT 1 / (1 - sum(t * l_tax) ** 2 / (sum(t ** 2) * sum(l_tax ** 2))) AS left_over
           FROM (SELECT 2 * l_quantity + l_tax AS t, l_tax FROM lineitem))
SELECT l_orderkey, l_linenumber, 2 * l_quantity + l_tax AS twice, l_tax FROM lineitem, v WHERE left_over <= 5""")
def vif_eliminate(spark, sf):
    frame = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"), "l_tax")
    return C.MulticollinearityReducer(columns=["l_quantity", "twice", "l_tax"]).fit(frame).transform(frame)


def _gram_sql(names, source):
    """All cross products as ``g_i_j``, in one row."""
    return ", ".join(f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)


def _det(rows):
    """Determinant of the Gram matrix of the columns with these numbers, by its first row."""
    def minor(r, c):
        if not r:
            return "1.0::DOUBLE"
        return "(" + " + ".join(f"{'-' if k % 2 else ''}1 * g{min(r[0], j)}{max(r[0], j)} * {minor(r[1:], c[:k] + c[k + 1:])}"
                                for k, j in enumerate(c)) + ")"
    return minor(list(rows), list(rows))


def _history_sql(names, rounds):
    """Inflations of the columns left in each round: Gram minors over the whole Gram determinant."""
    return " UNION ALL ".join(
        f"SELECT {r}::INTEGER AS round, '{names[i]}' AS feature, round(g{i}{i} * {_det([j for j in left if j != i])} / {_det(left)}, 3) AS vif FROM g"
        for r, left in enumerate(rounds) for i in left)


_HISTORY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]


@query("vif_history", f"""
WITH l AS (SELECT l_quantity / 30 AS l_quantity, l_extendedprice / 40000 AS l_extendedprice, l_discount * 20 AS l_discount, l_tax * 25 AS l_tax,
                  l_extendedprice * (1 - l_discount) / 40000 AS net FROM lineitem),
     g AS (SELECT {_gram_sql(_HISTORY, 'l')} FROM l)
{_history_sql(_HISTORY, [[0, 1, 2, 3, 4], [0, 2, 3, 4]])}""")
def vif_history(spark, sf):
    frame = lines(spark, sf).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    model = C.MulticollinearityReducer(vif_threshold=4.0).fit(frame)
    rows = [(i, c, float(v)) for i, step in enumerate(model.history) for c, v in step.items()]
    return rounded(spark.createDataFrame(rows, "round int, feature string, vif double"), 3)


_GAPS = """(SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS x,
                   CASE WHEN l_linenumber <> 5 THEN l_tax END AS y FROM lineitem)"""


@query("vif_missing_policy", " UNION ALL ".join(f"""
SELECT '{name}' AS policy, round(1 / (1 - sum(x * y) ** 2 / (sum(x * x) * sum(y * y))), 6) AS vif FROM (
  SELECT {x} AS x, {y} AS y FROM {_GAPS}, (SELECT avg(x) AS mx, avg(y) AS my, median(x) AS dx, median(y) AS dy FROM {_GAPS})
  WHERE {where})""" for name, x, y, where in (
    ("drop", "x", "y", "x IS NOT NULL AND y IS NOT NULL"), ("fill_mean", "coalesce(x, mx)", "coalesce(y, my)", "true"),
    ("fill_median", "coalesce(x, dx)", "coalesce(y, dy)", "true"))))
def vif_missing_policy(spark, sf):
    n = F.col("l_linenumber")
    frame = table(spark, sf, "lineitem").select(null_when(n == 3, "l_quantity").alias("x"),
                                                null_when(n == 5, "l_tax").alias("y"))
    rows = []
    for policy in C.MISSING:
        model = C.MulticollinearityReducer(handle_missing=policy).fit(frame)
        rows.append((policy, model.history[0]["x"]))
    return rounded(spark.createDataFrame(rows, "policy string, vif double"))


@query("vif_zero_variance", """SELECT l_orderkey, l_linenumber, l_quantity, l_tax, 1.0::DOUBLE AS one FROM lineitem""")
def vif_zero_variance(spark, sf):
    frame = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                                                F.lit(1.0).alias("one"))
    reducer = C.MulticollinearityReducer(max_iter=None, drop_constant_first=True, columns=["l_quantity", "l_tax", "one"])
    model = reducer.fit(frame)
    return frame.select(*sorted(model.selected, key=frame.columns.index))


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in NAMES for b in NAMES))
def corr_matrix(spark, sf):
    return rounded(C.corr_table(lines(spark, sf)))


@query("corr_eliminate", """
WITH m AS (SELECT abs(corr(l_quantity, 2 * l_quantity + l_tax)) AS ab, abs(corr(l_quantity, l_discount)) AS ac FROM lineitem)
SELECT l_orderkey, l_linenumber, l_discount, 2 * l_quantity + l_tax AS twice FROM lineitem, m WHERE ab > 0.8 AND ac <= 0.8""")
def corr_eliminate(spark, sf):
    frame = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"))
    names = ["l_quantity", "l_discount", "twice"]
    kept, _ = C.prune_correlated(names, C.correlations(frame, names), 0.8)
    return frame.select("l_orderkey", "l_linenumber", *kept)


@query("collinear_auto", """
SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_linenumber = 1 THEN l_quantity ELSE -l_quantity END AS signed
FROM lineitem WHERE (SELECT abs(corr(s, 2 * s + t)) FROM (SELECT l_tax AS t,
  CASE WHEN l_linenumber = 1 THEN l_quantity ELSE -l_quantity END AS s FROM lineitem)) > 0.9""")
def collinear_auto(spark, sf):
    signed = F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    frame = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", signed.alias("signed"), (signed * 2 + F.col("l_tax")).alias("twice"))
    # so high a limit leaves the pair to the correlation rule, which drops the later column
    model = auto_collinear(frame, vif_threshold=1e12, columns=["l_discount", "signed", "twice"])
    return model.transform(frame)


# the first of the three that determine each other goes; what is left stays within the limits
@query("collinear_auto_reasons", """
SELECT 'l_quantity' AS feature, 'Infinity'::DOUBLE AS value, 'inflation' AS reason
FROM (SELECT abs(corr(l_quantity, 2 * l_quantity + l_tax)) AS r FROM lineitem) WHERE r > 0.99""")
def collinear_auto_reasons(spark, sf):
    frame = lines(spark, sf, (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"))
    return rounded(auto_collinear(frame, critical_cols=["l_extendedprice"]).reasons(frame))


@query("collinear_select", """SELECT 3 * l_quantity AS thrice, l_returnflag FROM lineitem""")
def collinear_select(spark, sf):
    """The fitted selection applied: of two columns that determine each other the first goes, text stays."""
    frame = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") * 3).alias("thrice"), "l_returnflag")
    return C.MulticollinearityReducer().fit(frame).transform(frame)
