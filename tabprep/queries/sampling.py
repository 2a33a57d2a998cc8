"""Splits, samples, weights, synthetic rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from tabprep.operators import sampling as S
from tabprep.queries.registry import query, rounded, table


@query("split_stratified", """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
                  ORDER BY md5(event_id::VARCHAR || '42')) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, CASE WHEN k <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def split_stratified(spark, sf):
    return S.stratified_split(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("split_head", """
SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 777
       THEN 'head' ELSE 'tail' END AS split FROM orders""")
def split_head(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return S.split_head(frame, 777, "o_orderdate", "o_orderkey")


@query("split_stratified_many", """
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR || '42')) AS k,
                  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN k <= floor(n * 0.4 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def split_stratified_many(spark, sf):
    """A class for each customer: as many cuts as customers, all found at once."""
    return S.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 0.4)


@query("split_head_large_keys", """
WITH k AS (SELECT o_orderkey, 9007199254740992 + o_orderkey // 3 AS big, o_orderstatus || o_orderkey AS name,
                  (o_orderkey % 100 - 50)::DECIMAL(10,0) * 0.00000001::DECIMAL(9,8) + 1234567890123456789012345::DECIMAL(33,8) AS wide FROM orders)
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY big, o_orderkey) <= 1234 THEN 'head' ELSE 'tail' END AS by_key,
       CASE WHEN row_number() OVER (ORDER BY wide, o_orderkey) <= 1234 THEN 'head' ELSE 'tail' END AS by_decimal,
       CASE WHEN row_number() OVER (ORDER BY name) <= 1234 THEN 'head' ELSE 'tail' END AS by_text FROM k""")
def split_head_large_keys(spark, sf):
    """Keys that a double cannot tell apart, decimals of 33 digits, and text, each in its own order."""
    small = (F.col("o_orderkey") % 100 - 50).cast("decimal(10,0)") * F.lit(Decimal("0.00000001"))
    out = table(spark, sf, "orders").select(
        "o_orderkey", (F.lit(1 << 53) + F.expr("o_orderkey div 3")).alias("big"),
        F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("name"),
        (small + F.lit(Decimal("1234567890123456789012345.00000000"))).cast("decimal(38,8)").alias("wide"))
    out = S.split_head(out, 1234, "big", "o_orderkey", "by_key")
    out = S.split_head(out, 1234, "wide", "o_orderkey", "by_decimal")
    return S.split_head(out, 1234, "name", None, "by_text").select("o_orderkey", "by_key", "by_decimal", "by_text")


@query("sample_n", """SELECT * FROM orders ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey LIMIT 1000""")
def sample_n(spark, sf):
    return S.sample_rows(table(spark, sf, "orders"), "o_orderkey", 1000)


@query("class_weights", """
SELECT event_type AS class, count(*) AS n, round((SELECT count(*)::DOUBLE FROM events)
       / ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 9) AS weight FROM events GROUP BY 1""")
def class_weights(spark, sf):
    return rounded(S.class_weights(table(spark, sf, "events"), "event_type"), 9)


@query("class_weights_attached", """
WITH w AS (SELECT quality, (SELECT count(*)::DOUBLE FROM labels) / (2 * count(*)) AS weight FROM labels GROUP BY 1)
SELECT doc_id, quality, round(weight, 9) AS weight FROM labels JOIN w USING (quality)""")
def class_weights_attached(spark, sf):
    frame = table(spark, sf, "labels").select("doc_id", "quality")
    return rounded(S.with_class_weights(frame, "quality"), 9)


# every minority row gets the same number of copies, the remainder by hash; whole-number features
_SMOTE = """
WITH e AS (SELECT event_id AS id, user_id::DOUBLE AS a, minute(ts)::DOUBLE AS b, (event_id % 20 = 0)::INTEGER AS y FROM events),
     n AS (SELECT count(*) FILTER (y = 1) AS few, count(*) FILTER (y = 0) AS most FROM e),
     m AS (SELECT id, a, b, row_number() OVER (ORDER BY md5(id::VARCHAR || '42')) AS h FROM e WHERE y = 1),
     c AS (SELECT id, a, b, (most - few) // few + (h <= (most - few) % few)::INT AS copies FROM m, n),
     p AS (SELECT q.id, d.id AS other, d.a AS oa, d.b AS ob, row_number() OVER (PARTITION BY q.id
             ORDER BY (q.a - d.a) ** 2 + (q.b - d.b) ** 2, d.id) AS r FROM m q, m d WHERE q.id <> d.id),
     k AS (SELECT id, a, b, unnest(range(copies)) AS copy FROM c),
     u AS (SELECT id, a, b, ('0x' || substr(md5(id || '#' || copy || '42n'), 1, 13))::BIGINT % 5 + 1 AS pick,
                  ('0x' || substr(md5(id || '#' || copy || '42g'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS gap FROM k)
SELECT a, b, y, 0::INTEGER AS synthetic FROM e UNION ALL
SELECT round(u.a + gap * (oa - u.a), 6), round(u.b + gap * (ob - u.b), 6), 1, 1
FROM u JOIN p ON u.id = p.id AND u.pick = p.r"""


@query("smote", _SMOTE)
def smote(spark, sf):
    frame = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("a"),
        F.minute("ts").cast("double").alias("b"), (F.col("event_id") % 20 == 0).cast("int").alias("y"))
    return rounded(S.smote(frame, "y", 1, "id"))
