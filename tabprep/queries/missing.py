"""Missing values. Nulls are put in by key, since the given tables have none."""

from pyspark.sql import functions as F

from tabprep.functions.columns import as_double
from tabprep.operators import missing as M
from tabprep.operators.outliers import OutlierDetector
from tabprep.operators.scaling import FeatureScaler
from tabprep.plans.auto import impute_auto as auto_impute
from tabprep.queries.registry import null_when, query, rounded, table

# fixed recipes of the nulls, the same in Spark and SQL
_LINES = """(SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity, l_extendedprice AS price,
    CASE WHEN l_linenumber <> 2 THEN l_discount END AS discount,
    CASE WHEN l_linenumber <> 4 THEN l_returnflag END AS returnflag FROM lineitem)"""
_EVENTS = """(SELECT event_id, user_id, hour(ts)::BIGINT AS hour,
    CASE WHEN event_id % 50 <> 0 THEN value END AS value_2,
    CASE WHEN event_id % 10 <> 0 THEN value END AS value_10,
    CASE WHEN event_id % 2 <> 0 THEN value END AS value_50,
    CASE WHEN event_id < 0 THEN value END AS value_all,
    CASE WHEN event_id % 40 <> 0 THEN event_type END AS event_type FROM events)"""


def lines(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", null_when(n == 3, "l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), null_when(n == 2, "l_discount").alias("discount"),
        null_when(n == 4, "l_returnflag").alias("returnflag"))


def events(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.hour("ts").cast("bigint").alias("hour"),
        null_when(k % 50 == 0, "value").alias("value_2"),
        null_when(k % 10 == 0, "value").alias("value_10"),
        null_when(k % 2 == 0, "value").alias("value_50"),
        null_when(k >= 0, "value").alias("value_all"),
        null_when(k % 40 == 0, "event_type").alias("event_type"))


@query("impute_flag_scale", f"""
WITH g AS (SELECT l_orderkey, l_linenumber, quantity FROM {_LINES}),
     f AS (SELECT l_orderkey, l_linenumber, coalesce(quantity, (SELECT median(quantity) FROM g)) AS quantity,
                  (quantity IS NULL)::INTEGER AS "quantity_Missing_Flag" FROM g),
     s AS (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3,
                  avg(quantity) AS m, stddev_pop(quantity) AS d FROM f)
SELECT l_orderkey, l_linenumber, quantity, "quantity_Missing_Flag",
       (quantity < q1 - 1.5 * (q3 - q1) OR quantity > q3 + 1.5 * (q3 - q1))::INTEGER AS "Outlier_Flag",
       round((quantity - m) / d, 6) AS quantity_scaled FROM f, s""")
def impute_flag_scale(spark, sf):
    keys = lines(spark, sf).select("l_orderkey", "l_linenumber", "quantity")
    filled = M.MissingValueHandler().fit(keys.select("quantity")).transform(keys)
    flagged = OutlierDetector(columns=["quantity"]).fit(filled).transform(filled)
    return rounded(FeatureScaler(columns=["quantity"]).fit(filled).transform(flagged), 6, ["quantity_scaled"])


def _profile_sql(columns):
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
       (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_pct,
       (count({c}) < count(*))::INTEGER AS has_missing,
       CASE WHEN count({c}) = 0 THEN 'All NaNs'
            WHEN (count(*) - count({c})) * 100.0 / count(*) < 5 THEN '<5%'
            WHEN (count(*) - count({c})) * 100.0 / count(*) <= 30 THEN '5–30%'
            ELSE '>30%' END AS band FROM {_EVENTS}""" for c in columns)


@query("missing_profile", _profile_sql(
    ["event_id", "user_id", "hour", "value_2", "value_10", "value_50", "value_all", "event_type"]))
def missing_profile(spark, sf):
    return M.missing_profile(events(spark, sf))


@query("missing_row_flag", f"""
SELECT *, (quantity IS NULL OR discount IS NULL OR returnflag IS NULL)::INTEGER AS "Missing_Flag"
FROM {_LINES}""")
def missing_row_flag(spark, sf):
    return M.missing_row_flag(lines(spark, sf))


@query("missing_drop_columns", f"""SELECT event_id, user_id, hour, value_2, value_10, event_type
                                   FROM {_EVENTS}""")
def missing_drop_columns(spark, sf):
    frame = events(spark, sf)
    fitted = M.MissingValueHandler("constant", "constant").fit(frame)
    return frame.drop(*fitted.dropped)


@query("missing_drop_columns_strict", f"""
SELECT event_id, hour, value_10, third FROM (SELECT *, CASE WHEN event_id % 10 > 2 THEN hour END AS third,
       CASE WHEN event_id % 10 > 3 THEN hour END AS fourth FROM {_EVENTS})""")
def missing_drop_columns_strict(spark, sf):
    k = F.col("event_id") % 10
    frame = events(spark, sf).select(
        "event_id", "hour", "value_10", F.when(k > 2, F.col("hour")).alias("third"),
        F.when(k > 3, F.col("hour")).alias("fourth"))
    fitted = M.MissingValueHandler("constant", "constant", drop_high_missing_threshold=0.3,
                                   strictly_above=True).fit(frame)
    return frame.drop(*fitted.dropped)


def _imputed(spark, sf, **settings):
    frame = lines(spark, sf)
    fitted = M.MissingValueHandler(add_missing_flag=False, **settings).fit(
        frame.drop("l_orderkey", "l_linenumber"))
    return rounded(fitted.transform(frame))


def _fill_sql(measure):
    return f"""
WITH g AS (SELECT * FROM {_LINES}),
     m AS (SELECT returnflag FROM g WHERE returnflag IS NOT NULL GROUP BY 1
           ORDER BY count(*) DESC, returnflag LIMIT 1)
SELECT l_orderkey, l_linenumber, round(coalesce(quantity, (SELECT {measure}(quantity) FROM g)), 6) AS quantity,
       price, round(coalesce(discount, (SELECT {measure}(discount) FROM g)), 6) AS discount,
       coalesce(returnflag, (SELECT returnflag FROM m)) AS returnflag FROM g"""


@query("impute_mean", _fill_sql("avg"))
def impute_mean(spark, sf):
    return _imputed(spark, sf, numeric_strategy="mean")


@query("impute_median", _fill_sql("median"))
def impute_median(spark, sf):
    return _imputed(spark, sf, numeric_strategy="median")


@query("impute_mode", f"""
WITH g AS (SELECT * FROM {_LINES}),
     q AS (SELECT quantity FROM g WHERE quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
     d AS (SELECT discount FROM g WHERE discount IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
     r AS (SELECT returnflag FROM g WHERE returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(quantity, (SELECT quantity FROM q)) AS quantity, price,
       coalesce(discount, (SELECT discount FROM d)) AS discount,
       coalesce(returnflag, (SELECT returnflag FROM r)) AS returnflag FROM g""")
def impute_mode(spark, sf):
    return _imputed(spark, sf, numeric_strategy="most_frequent")


@query("impute_constant", f"""
SELECT l_orderkey, l_linenumber, coalesce(quantity, 0.0) AS quantity, price, coalesce(discount, 0.0) AS discount,
       coalesce(returnflag, 'missing_value') AS returnflag FROM {_LINES}""")
def impute_constant(spark, sf):
    return _imputed(spark, sf, numeric_strategy="constant", categorical_strategy="constant")


@query("missing_column_flags", f"""
WITH g AS (SELECT * FROM {_LINES})
SELECT l_orderkey, l_linenumber, coalesce(quantity, 0.0) AS quantity, price, coalesce(discount, 0.0) AS discount,
       coalesce(returnflag, 'missing_value') AS returnflag,
       (quantity IS NULL)::INTEGER AS "quantity_Missing_Flag",
       (discount IS NULL)::INTEGER AS "discount_Missing_Flag",
       (returnflag IS NULL)::INTEGER AS "returnflag_Missing_Flag" FROM g""")
def missing_column_flags(spark, sf):
    frame = lines(spark, sf)
    fitted = M.MissingValueHandler("constant", "constant").fit(frame.drop("l_orderkey", "l_linenumber"))
    return fitted.transform(frame)


# features are whole numbers, so that equal distances are equal in both engines
_KNN = """
WITH g AS (SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN value END AS v, user_id::DOUBLE AS a,
                  CASE WHEN event_id % 7 <> 0 THEN hour(ts)::DOUBLE END AS b, minute(ts)::DOUBLE AS c FROM events),
     p AS (SELECT q.id, d.v, row_number() OVER (PARTITION BY q.id ORDER BY
             CASE WHEN q.b IS NULL OR d.b IS NULL
                  THEN ((q.a - d.a) ** 2 + (q.c - d.c) ** 2) * 4 / 2
                  ELSE ((q.a - d.a) ** 2 + (q.b - d.b) ** 2 + (q.c - d.c) ** 2) * 4 / 3 END, d.id) AS r
           FROM g q, g d WHERE q.v IS NULL AND d.v IS NOT NULL),
     f AS (SELECT id, avg(v) AS v FROM p WHERE r <= 5 GROUP BY id)
SELECT g.id, round(coalesce(g.v, f.v), 6) AS v, a, b, c FROM g LEFT JOIN f ON g.id = f.id"""


@query("impute_knn", _KNN)
def impute_knn(spark, sf):
    frame = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), null_when(F.col("event_id") % 10 == 0, "value").alias("v"),
        as_double("user_id").alias("a"),
        F.when(F.col("event_id") % 7 != 0, F.hour("ts").cast("double")).alias("b"),
        F.minute("ts").cast("double").alias("c"))
    return rounded(M.impute_knn(frame, "id", ["v"]), 6, ["v"])


@query("impute_knn_cells", _KNN)
def impute_knn_cells(spark, sf):
    """The same search through the cell tree, as it runs where donors are too many for every task."""
    frame = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), null_when(F.col("event_id") % 10 == 0, "value").alias("v"),
        as_double("user_id").alias("a"),
        F.when(F.col("event_id") % 7 != 0, F.hour("ts").cast("double")).alias("b"),
        F.minute("ts").cast("double").alias("c"))
    return rounded(M.impute_knn(frame, "id", ["v"], plan="cells"), 6, ["v"])


# twelve columns, each with gaps of its own: (multiplier, modulus, gap multiplier); a value is missing in 3 of 10 rows
_GAPS = [(17, 23, 3), (29, 31, 7), (41, 19, 11), (53, 37, 13), (67, 29, 17), (71, 41, 19), (83, 17, 23), (97, 43, 29),
         (101, 13, 31), (113, 47, 37), (127, 11, 41), (139, 53, 43)]
_GAP_COLUMNS = ", ".join(
    f"CASE WHEN (event_id * {g} + event_id // {k + 3}) % 10 >= 3 THEN (event_id * {m} // 7 % {q})::DOUBLE END AS x{k}"
    for k, (m, q, g) in enumerate(_GAPS))
_GAP_SUM = " + ".join(f"coalesce((q.x{k} - d.x{k}) ** 2, 0)" for k in range(12))
_GAP_USED = " + ".join(f"(q.x{k} IS NOT NULL AND d.x{k} IS NOT NULL)::INT" for k in range(12))


@query("impute_knn_gaps", f"""
WITH g AS (SELECT event_id AS id, {_GAP_COLUMNS} FROM events),
     p AS (SELECT q.id, d.x0 AS v0, d.x5 AS v5, q.x0 IS NULL AS n0, q.x5 IS NULL AS n5, d.id AS donor,
                  ({_GAP_SUM}) * 12 / ({_GAP_USED}) AS far
           FROM g q, g d WHERE (q.x0 IS NULL OR q.x5 IS NULL) AND {_GAP_USED} > 0),
     a AS (SELECT id, v0, row_number() OVER (PARTITION BY id ORDER BY far, donor) AS r FROM p WHERE n0 AND v0 IS NOT NULL),
     b AS (SELECT id, v5, row_number() OVER (PARTITION BY id ORDER BY far, donor) AS r FROM p WHERE n5 AND v5 IS NOT NULL)
SELECT g.id, round(coalesce(x0, (SELECT avg(v0) FROM a WHERE a.id = g.id AND r <= 5), (SELECT avg(x0) FROM g)), 6) AS x0,
       round(coalesce(x5, (SELECT avg(v5) FROM b WHERE b.id = g.id AND r <= 5), (SELECT avg(x5) FROM g)), 6) AS x5 FROM g""")
def impute_knn_gaps(spark, sf):
    """Two of twelve columns with independent gaps, so that nearly every row lacks a combination of its own."""
    k = F.col("event_id")
    frame = table(spark, sf, "events").select(k.alias("id"), *[
        F.when((k * g + F.expr(f"event_id div {i + 3}")) % 10 >= 3,
               (F.expr(f"event_id * {m} div 7") % q).cast("double")).alias(f"x{i}")
        for i, (m, q, g) in enumerate(_GAPS)])
    filled = M.impute_knn(frame, "id", ["x0", "x5"], plan="cells")
    return rounded(filled.select("id", "x0", "x5"), 6, ["x0", "x5"])


@query("impute_knn_fitted", """
WITH g AS (SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN (user_id % 50)::DOUBLE END AS a,
                  CASE WHEN event_id % 7 > 1 THEN hour(ts)::DOUBLE END AS b,
                  CASE WHEN event_id % 11 <> 0 THEN minute(ts)::DOUBLE END AS c, event_type FROM events),
     q AS (SELECT *, a IS NULL AS na, b IS NULL AS nb, c IS NULL AS nc FROM g WHERE id % 4 = 0),
     d AS (SELECT * FROM g WHERE id % 4 <> 0),
     p AS (SELECT q.id, d.id AS donor, d.a, d.b, d.c, na, nb, nc,
                  (coalesce((q.a - d.a) ** 2, 0) + coalesce((q.b - d.b) ** 2, 0) + coalesce((q.c - d.c) ** 2, 0)) * 3
                  / nullif((q.a IS NOT NULL AND d.a IS NOT NULL)::INT + (q.b IS NOT NULL AND d.b IS NOT NULL)::INT
                           + (q.c IS NOT NULL AND d.c IS NOT NULL)::INT, 0) AS far
           FROM q, d WHERE na OR nb OR nc),
     ra AS (SELECT id, a, row_number() OVER (PARTITION BY id ORDER BY far, donor) AS r FROM p WHERE na AND a IS NOT NULL AND far IS NOT NULL),
     rb AS (SELECT id, b, row_number() OVER (PARTITION BY id ORDER BY far, donor) AS r FROM p WHERE nb AND b IS NOT NULL AND far IS NOT NULL),
     rc AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY far, donor) AS r FROM p WHERE nc AND c IS NOT NULL AND far IS NOT NULL)
SELECT id, event_type,
       round(coalesce(a, (SELECT avg(ra.a) FROM ra WHERE ra.id = q.id AND r <= 4), (SELECT avg(a) FROM d)), 6) AS a,
       round(coalesce(b, (SELECT avg(rb.b) FROM rb WHERE rb.id = q.id AND r <= 4), (SELECT avg(b) FROM d)), 6) AS b,
       round(coalesce(c, (SELECT avg(rc.c) FROM rc WHERE rc.id = q.id AND r <= 4), (SELECT avg(c) FROM d)), 6) AS c,
       na::INTEGER AS "a_Missing_Flag", nb::INTEGER AS "b_Missing_Flag", nc::INTEGER AS "c_Missing_Flag" FROM q""")
def impute_knn_fitted(spark, sf):
    """The neighbour strategy of the handler, fitted on three quarters of the rows and applied to the others."""
    k = F.col("event_id")
    frame = table(spark, sf, "events").select(
        k.alias("id"), F.when(k % 9 != 0, (F.col("user_id") % 50).cast("double")).alias("a"),
        F.when(k % 7 > 1, F.hour("ts").cast("double")).alias("b"),
        F.when(k % 11 != 0, F.minute("ts").cast("double")).alias("c"), "event_type")
    handler = M.MissingValueHandler("knn", knn_neighbors=4, key="id")
    fitted = handler.fit(frame.where("id % 4 <> 0"))
    return rounded(fitted.transform(frame.where("id % 4 = 0")))


@query("impute_nan", """
WITH g AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value, value IS NULL AS x FROM events)
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM g)), 6) AS value,
       (value IS NULL)::INTEGER AS "value_Missing_Flag",
       (SELECT count(*) - count(value) FROM g) AS missing FROM g""")
def impute_nan(spark, sf):
    """NaN counts, is flagged and is filled like NULL."""
    k = F.col("event_id")
    frame = table(spark, sf, "events").select("event_id", F.when(k % 12 == 0, F.lit(float("nan")))
                                              .when(k % 6 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))
    profile = M.missing_profile(frame, ["value"]).select(F.col("missing_count").alias("missing"))
    filled = M.MissingValueHandler("mean", key="event_id").fit(frame).transform(frame)
    return rounded(filled.join(F.broadcast(profile)), 6, ["value"])


@query("impute_knn_categorical", """
WITH w AS (SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS kind,
                  user_id::DOUBLE AS a, minute(ts)::DOUBLE AS b, (event_id % 3)::VARCHAR AS third,
                  (event_id % 3)::DOUBLE AS t FROM events),
     p AS (SELECT q.id, d.kind, row_number() OVER (PARTITION BY q.id ORDER BY
             ((q.a - d.a) ** 2 + (q.b - d.b) ** 2 + (q.t - d.t) ** 2) * 3 / 3, d.id) AS r
           FROM w q, w d WHERE q.kind IS NULL AND d.kind IS NOT NULL),
     v AS (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, kind) AS r
           FROM p WHERE r <= 5 GROUP BY id, kind)
SELECT w.id, coalesce(w.kind, v.kind) AS kind, a, b, third
FROM w LEFT JOIN v ON w.id = v.id AND v.r = 1""")
def impute_knn_categorical(spark, sf):
    frame = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), null_when(F.col("event_id") % 10 == 0, "event_type").alias("kind"),
        as_double("user_id").alias("a"), F.minute("ts").cast("double").alias("b"),
        (F.col("event_id") % 3).cast("string").alias("third"))
    return M.impute_knn_text(frame, "id", "kind", ["a", "b", "third"])


@query("impute_ffill_bfill", """
WITH g AS (SELECT event_id, ts, CASE WHEN event_id % 10 > 3 THEN value END AS value,
                  CASE WHEN event_id % 4 = 1 THEN event_type END AS event_type FROM events),
     f AS (SELECT event_id, ts,
             last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v1,
             first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v2,
             last_value(event_type IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS e1,
             first_value(event_type IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e2
           FROM g)
SELECT event_id, ts, coalesce(v1, v2) AS value, coalesce(e1, e2) AS event_type FROM f""")
def impute_ffill_bfill(spark, sf):
    k = F.col("event_id")
    frame = table(spark, sf, "events").select(
        "event_id", "ts", F.when(k % 10 > 3, F.col("value")).alias("value"),
        F.when(k % 4 == 1, F.col("event_type")).alias("event_type"))
    return M.fill_in_time(frame, "ts", "event_id")


@query("impute_ffill_bfill_by_user", """
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 10 > 3 THEN value END AS value FROM events)
SELECT event_id, user_id, ts, coalesce(
    last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
    first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM g""")
def impute_ffill_bfill_by_user(spark, sf):
    frame = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 10 > 3, F.col("value")).alias("value"))
    return M.fill_in_time(frame, "ts", "event_id", partition_by=["user_id"])


@query("impute_regression", """
WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax,
                  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 3 + l_discount * 20 + 1 END AS y FROM lineitem),
     m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM g)
SELECT l_orderkey, l_linenumber, x, l_tax, round(coalesce(y, a + b * x), 6) AS y FROM g, m""")
def impute_regression(spark, sf):
    frame = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), "l_tax",
        F.when(F.col("l_linenumber") % 2 == 0,
               F.col("l_quantity") * 3 + F.col("l_discount") * 20 + 1).alias("y"))
    fitted = M.RegressionImputer("y", 0.5, ["x", "l_tax"]).fit(frame)
    return rounded(fitted.transform(frame), 6, ["y"])


@query("impute_auto", f"""
WITH g AS (SELECT event_id, user_id, value_2, event_type,
             CASE WHEN event_id % 30 <> 0 THEN hour END AS hour_gaps, value_50 FROM {_EVENTS}),
     m AS (SELECT median(value_2) AS v, avg(hour_gaps) AS h FROM g),
     t AS (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, user_id, round(coalesce(value_2, v), 6) AS value_2,
       coalesce(event_type, (SELECT event_type FROM t)) AS event_type,
       round(coalesce(hour_gaps, h), 6) AS hour_gaps FROM g, m""")
def impute_auto(spark, sf):
    frame = events(spark, sf).select(
        "event_id", "user_id", "value_2", "event_type",
        F.when(F.col("event_id") % 30 != 0, F.col("hour")).alias("hour_gaps"), "value_50")
    return rounded(auto_impute(frame, "event_id")[0])


@query("impute_auto_critical", """
WITH g AS (SELECT event_id, value, user_id::DOUBLE AS u, CASE WHEN event_id % 2 = 0 THEN 3 * value - 7 + user_id / 1000.0::DOUBLE END AS y,
                  CASE WHEN event_id % 3 = 0 THEN (event_id * 7919 % 1000)::DOUBLE END AS lone FROM events),
     m AS (SELECT regr_slope(y, value) AS b, regr_intercept(y, value) AS a FROM g)
SELECT event_id, round(value, 6) AS value, u, round(coalesce(y, a + b * value), 6) AS y FROM g, m""")
def impute_auto_critical(spark, sf):
    """Half empty but needed: one column is filled by regression, another has no predictor and goes."""
    k = F.col("event_id")
    frame = table(spark, sf, "events").select(
        "event_id", "value", F.col("user_id").cast("double").alias("u"),
        F.when(k % 2 == 0, F.col("value") * 3 - 7 + F.col("user_id") / 1000).alias("y"),
        F.when(k % 3 == 0, (k * 7919 % 1000).cast("double")).alias("lone"))
    return rounded(auto_impute(frame, "event_id", critical_cols=["y", "lone"])[0])


@query("impute_auto_neighbours", """
WITH g AS (SELECT event_id AS id, CASE WHEN event_id % 8 <> 0 THEN (user_id % 60)::DOUBLE END AS a, hour(ts)::DOUBLE AS b,
                  minute(ts)::DOUBLE AS c FROM events),
     p AS (SELECT q.id, d.a, row_number() OVER (PARTITION BY q.id ORDER BY (q.b - d.b) ** 2 + (q.c - d.c) ** 2, d.id) AS r
           FROM g q, g d WHERE q.a IS NULL AND d.a IS NOT NULL),
     f AS (SELECT id, avg(a) AS a FROM p WHERE r <= 5 GROUP BY id)
SELECT g.id, round(coalesce(g.a, f.a), 6) AS a, b, c FROM g LEFT JOIN f ON f.id = g.id""")
def impute_auto_neighbours(spark, sf):
    k = F.col("event_id")
    frame = table(spark, sf, "events").select(
        k.alias("id"), F.when(k % 8 != 0, (F.col("user_id") % 60).cast("double")).alias("a"),
        F.hour("ts").cast("double").alias("b"), F.minute("ts").cast("double").alias("c"))
    return rounded(auto_impute(frame, "id")[0])


@query("impute_auto_report", f"""
SELECT * FROM (VALUES ('value_2', 'median'), ('event_type', 'most frequent'), ('value_10', 'neighbours'),
                      ('value_50', 'dropped')) AS m("column", method)
JOIN (SELECT 'value_2' AS "column", (count(*) - count(value_2)) * 100.0::DOUBLE / count(*) AS missing_pct FROM {_EVENTS}
      UNION ALL SELECT 'event_type', (count(*) - count(event_type)) * 100.0::DOUBLE / count(*) FROM {_EVENTS}
      UNION ALL SELECT 'value_10', (count(*) - count(value_10)) * 100.0::DOUBLE / count(*) FROM {_EVENTS}
      UNION ALL SELECT 'value_50', (count(*) - count(value_50)) * 100.0::DOUBLE / count(*) FROM {_EVENTS})
USING ("column")""")
def impute_auto_report(spark, sf):
    frame = events(spark, sf).select("event_id", "user_id", "value_2", "event_type", "value_10", "value_50")
    return auto_impute(frame, "event_id")[1]


@query("imputation_report", f"""
WITH g AS (SELECT * FROM {_EVENTS})
SELECT 'value_2' AS "column", 'mean' AS method, count(*) - count(value_2) AS missing_before,
       0::BIGINT AS missing_after, 1::INTEGER AS flagged FROM g
UNION ALL SELECT 'value_10', 'mean', count(*) - count(value_10), 0, 1 FROM g
UNION ALL SELECT 'value_50', 'dropped', count(*) - count(value_50), NULL, 0 FROM g
UNION ALL SELECT 'event_type', 'most_frequent', count(*) - count(event_type), 0, 1 FROM g
UNION ALL SELECT 'hour', 'none', count(*) - count(hour), 0, 0 FROM g""")
def imputation_report(spark, sf):
    frame = events(spark, sf).select("value_2", "value_10", "value_50", "event_type", "hour")
    return M.MissingValueHandler("mean").fit(frame).report(frame)
