"""Categorical encoders."""

from pyspark.sql import functions as F

from tabprep.operators import encoding as E
from tabprep.operators.encoding import CategoricalEncoder
from tabprep.plans.auto import encode_auto as auto_encode
from tabprep.queries.registry import null_when, query, rounded, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LEVELS = "CASE o_orderpriority " + " ".join(
    f"WHEN '{v}' THEN {i}.0" for i, v in enumerate(PRIORITIES)) + " END::DOUBLE"


def lines(spark, sf, *columns):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *columns)


@query("encode_detect", """
SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS unique_values,
       CASE WHEN count(DISTINCT l_returnflag) = 2 THEN 'binary' WHEN count(DISTINCT l_returnflag) > 20
            THEN 'high_cardinality' ELSE 'onehot' END AS encoding FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus),
       CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'binary' WHEN count(DISTINCT l_linestatus) > 20
            THEN 'high_cardinality' ELSE 'onehot' END FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate), CASE WHEN count(DISTINCT l_shipdate) > 20
            THEN 'high_cardinality' ELSE 'onehot' END FROM lineitem""")
def encode_detect(spark, sf):
    found = CategoricalEncoder().detect(lines(spark, sf, "l_returnflag", "l_linestatus", "l_shipdate"))
    return spark.createDataFrame([(c, n, k) for c, (k, n) in found.items()],
                                 "feature string, unique_values bigint, encoding string")


@query("encode_detect_explicit", """
SELECT * FROM (VALUES ('o_orderstatus', 'high_cardinality'), ('o_orderpriority', 'ordinal')) AS t(feature, encoding)
JOIN (SELECT 'o_orderstatus' AS feature, count(DISTINCT o_orderstatus) AS unique_values FROM orders
      UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders) USING (feature)""")
def encode_detect_explicit(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    model = CategoricalEncoder({"o_orderstatus": "high_cardinality"}, {"o_orderpriority": PRIORITIES}).fit(frame)
    return model.summary(frame)


@query("cat_summary", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {t}) AS unique_values,
       (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {t} ORDER BY 1 LIMIT 5)) AS first_values"""
    for t, c in (("part", "p_brand"), ("part", "p_type"))))
def cat_summary(spark, sf):
    return E.category_summary(table(spark, sf, "part"), ["p_brand", "p_type"])


@query("encode_label", """
WITH g AS (SELECT l_orderkey, l_linenumber,
             coalesce(CASE WHEN l_linenumber <> 4 THEN l_linestatus END, 'nan') AS s FROM lineitem),
     k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT s FROM g))
SELECT l_orderkey, l_linenumber, code::INTEGER AS l_linestatus FROM g JOIN k USING (s)""")
def encode_label(spark, sf):
    status = null_when(F.col("l_linenumber") == 4, "l_linestatus").alias("l_linestatus")
    frame = lines(spark, sf, status)
    return CategoricalEncoder().fit(frame).transform(frame)


@query("encode_ordinal", f"SELECT o_orderkey, {_LEVELS} AS o_orderpriority FROM orders")
def encode_ordinal(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return CategoricalEncoder(ordinal_features_map={"o_orderpriority": PRIORITIES}).fit(frame).transform(frame)


@query("encode_ordinal_codes", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 10.0
       WHEN o_orderpriority = '2-HIGH' THEN 7.5 ELSE -1.0 END::DOUBLE AS o_orderpriority FROM orders""")
def encode_ordinal_codes(spark, sf):
    frame = table(spark, sf, "orders").select(
        "o_orderkey", null_when(F.col("o_orderkey") % 5 == 0, "o_orderpriority").alias("o_orderpriority"))
    codes = {"o_orderpriority": {"1-URGENT": 10.0, "2-HIGH": 7.5}}
    return CategoricalEncoder(ordinal_features_map=codes).fit(frame).transform(frame)


@query("encode_onehot", """
SELECT l_orderkey, l_linenumber,
       coalesce(l_linenumber <> 4 AND l_returnflag = 'A', false)::INT::DOUBLE AS "l_returnflag_A",
       coalesce(l_linenumber <> 4 AND l_returnflag = 'N', false)::INT::DOUBLE AS "l_returnflag_N",
       coalesce(l_linenumber <> 4 AND l_returnflag = 'R', false)::INT::DOUBLE AS "l_returnflag_R",
       (l_linenumber = 4)::INT::DOUBLE AS l_returnflag_nan FROM lineitem""")
def encode_onehot(spark, sf):
    returnflag = null_when(F.col("l_linenumber") == 4, "l_returnflag").alias("l_returnflag")
    frame = lines(spark, sf, returnflag)
    return CategoricalEncoder().fit(frame).transform(frame)


@query("encode_dummies", """
SELECT c_custkey, (c_mktsegment = 'BUILDING')::INTEGER AS "c_mktsegment_BUILDING",
       (c_mktsegment = 'FURNITURE')::INTEGER AS "c_mktsegment_FURNITURE",
       (c_mktsegment = 'HOUSEHOLD')::INTEGER AS "c_mktsegment_HOUSEHOLD",
       (c_mktsegment = 'MACHINERY')::INTEGER AS "c_mktsegment_MACHINERY" FROM customer""")
def encode_dummies(spark, sf):
    return E.encode_dummies(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("encode_frequency", """
WITH f AS (SELECT p_brand, count(*)::DOUBLE / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1)
SELECT p_partkey, round(share, 9) AS p_brand FROM part JOIN f USING (p_brand)""")
def encode_frequency(spark, sf):
    frame = table(spark, sf, "part").select("p_partkey", "p_brand")
    return rounded(CategoricalEncoder().fit(frame).transform(frame), 9)


@query("encode_frequency_many", """
WITH u AS (SELECT event_id, 'user ' || user_id AS who FROM events),
     f AS (SELECT who, count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM u GROUP BY 1)
SELECT event_id, round(share, 9) AS who FROM u JOIN f USING (who)""")
def encode_frequency_many(spark, sf):
    who = F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("who")
    frame = table(spark, sf, "events").select("event_id", who)
    return rounded(E.fit_frequency(frame, "who").transform(frame), 9)


@query("encode_quantile_bins", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont(value, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM events) SELECT event_id, (" + " + ".join(
    f"(value >= e{i})::INT" for i in range(1, 10)) + ")::DOUBLE AS value FROM events, q")
def encode_quantile_bins(spark, sf):
    frame = table(spark, sf, "events").select("event_id", "value")
    return E.QuantileBinEncoder(["value"]).fit(frame).transform(frame)


@query("encode_cluster")
def encode_cluster(spark, sf):
    frame = table(spark, sf, "part").select("p_partkey", "p_brand")
    return CategoricalEncoder(high_cardinality_strategy="clustering").fit(frame).transform(frame)


@query("encode_category_codes", """
WITH k AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part))
SELECT p_partkey, code::DOUBLE AS code FROM part JOIN k USING (p_name)""")
def encode_category_codes(spark, sf):
    frame = table(spark, sf, "part").select("p_partkey", "p_name")
    return E.category_codes(frame, "p_name", "code").select("p_partkey", "code")


@query("encode_target", """
WITH m AS (SELECT p_brand, avg(p_retailprice) AS price FROM part WHERE p_size <= 40 AND p_brand <> 'Brand#11' GROUP BY 1)
SELECT p_partkey, round(coalesce(m.price, (SELECT avg(price) FROM m)), 6) AS p_brand, p_retailprice
FROM part LEFT JOIN m ON part.p_brand = m.p_brand""")
def encode_target(spark, sf):
    part = table(spark, sf, "part")
    seen = part.where("p_size <= 40 AND p_brand <> 'Brand#11'").select("p_brand", "p_retailprice")
    model = CategoricalEncoder(high_cardinality_strategy="target").fit(seen, "p_retailprice")
    return rounded(model.transform(part.select("p_partkey", "p_brand", "p_retailprice")), 6, ["p_brand"])


@query("encode_unknown_policy", """
SELECT event_id, coalesce((SELECT count(DISTINCT s.event_type) FROM events s
         WHERE s.event_type <> 'error' AND s.event_type < e.event_type AND e.event_type <> 'error')::DOUBLE, -1.0)
         * (e.event_type <> 'error')::INT - (e.event_type = 'error')::INT AS code,
       CASE WHEN e.event_type = 'error' THEN -1 WHEN e.event_type = 'view' THEN 1 WHEN e.event_type = 'click' THEN 0
            ELSE -1 END::INTEGER AS two
FROM events e""")
def encode_unknown_policy(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("code"), F.col("event_type").alias("two"))
    seen = events.where("code <> 'error'").select("code")
    both = events.where("two IN ('view', 'click')").select("two")
    ordinal = CategoricalEncoder({"code": "ordinal"}).fit(seen)
    binary = CategoricalEncoder(handle_unknown="impute").fit(both)
    return ordinal.transform(binary.transform(events))


@query("encode_unknown_ignored", """
SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END::INTEGER AS two,
       (event_type = 'click')::INT::DOUBLE AS one_click, (event_type = 'purchase')::INT::DOUBLE AS one_purchase,
       (event_type = 'view')::INT::DOUBLE AS one_view FROM events""")
def encode_unknown_ignored(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("two"), F.col("event_type").alias("one"))
    binary = CategoricalEncoder().fit(events.where("two IN ('view', 'click')").select("two"))
    one_hot = CategoricalEncoder().fit(events.where("one IN ('view', 'click', 'purchase')").select("one"))
    return one_hot.transform(binary.transform(events))


@query("encode_auto", f"""
WITH f AS (SELECT o_custkey, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1)
SELECT o_orderkey, {_LEVELS} AS o_orderpriority, round(share, 9) AS who,
       (o_orderstatus = 'O')::INTEGER AS "o_orderstatus_O", (o_orderstatus = 'P')::INTEGER AS "o_orderstatus_P"
FROM orders JOIN f USING (o_custkey)""")
def encode_auto(spark, sf):
    frame = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_custkey").cast("string").alias("who"), "o_orderstatus")
    out, _ = auto_encode(frame, ["o_orderpriority", "who", "o_orderstatus"], {"o_orderpriority": PRIORITIES})
    return rounded(out, 9)


@query("encode_auto_report", """
SELECT 'p_brand' AS feature, count(DISTINCT p_brand) AS unique_values,
       CASE WHEN count(DISTINCT p_brand) <= 10 THEN 'dummies' ELSE 'share' END AS encoding FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type), CASE WHEN count(DISTINCT p_type) <= 10 THEN 'dummies'
       ELSE 'share' END FROM part""")
def encode_auto_report(spark, sf):
    return auto_encode(table(spark, sf, "part").select("p_brand", "p_type"), ["p_brand", "p_type"])[1]
